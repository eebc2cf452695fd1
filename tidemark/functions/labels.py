"""Label text (a="1",b="2") as maps and back, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = r'[^=,\s"]+\s*=\s*"(?:[^"\\]|\\.)*"'


def unescape(c: Column) -> Column:
    """Undoes backslash escapes of a quoted value: \\\\, \\" and \\n."""
    mark = "\u0001"
    c = F.regexp_replace(c, r"\\\\", mark)
    c = F.regexp_replace(F.regexp_replace(c, r"\\n", "\n"), r"\\(.)", "$1")
    return F.regexp_replace(c, mark, r"\\")


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")


def parse_labels(text: Column) -> Column:
    """map<string,string> of label text; null and blank text give an empty map; malformed text raises."""
    text = F.coalesce(text, F.lit(""))
    good = text.rlike(rf"^\s*(?:{_PAIR}\s*(?:,\s*{_PAIR}\s*)*,?\s*)?$")
    pairs = F.regexp_extract_all(text, F.lit(f"({_PAIR})"), F.lit(1))
    name = lambda p: F.regexp_extract(p, r'^([^=,\s"]+)', 1)
    value = lambda p: unescape(F.regexp_extract(p, r'(?s)^[^"]*"(.*)"$', 1))
    built = F.map_from_entries(F.transform(pairs, lambda p: F.struct(name(p).alias("key"), value(p).alias("value"))))
    return F.when(good, built).otherwise(F.raise_error(F.concat(F.lit("malformed labels: "), text)).cast("map<string,string>"))


def render_labels(m: Column) -> Column:
    """Label text of a map, names in ascending order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")


def merge_labels(base: Column, own: Column) -> Column:
    """Both maps; a sample's own label wins over one of its producer."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def keep(m: Column, names: Iterable[str]) -> Column:
    names = list(names)
    return F.map_filter(m, lambda k, _: k.isin(names)) if names else F.map_filter(m, lambda k, _: F.lit(False))


def drop(m: Column, names: Iterable[str]) -> Column:
    names = list(names)
    return F.map_filter(m, lambda k, _: ~k.isin(names)) if names else m


def set_label(m: Column, name: str, value: Column) -> Column:
    """The map with one label set; an empty value removes it."""
    rest = drop(m, [name])
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def matches(label: Column, op: str, value: str) -> Column:
    """A label matcher; an absent label is the empty string and patterns match whole values."""
    label = F.coalesce(label, F.lit(""))
    if op == "=":
        return label == value
    if op == "!=":
        return label != value
    hit = label.rlike(f"^(?s:{value})$")
    return hit if op == "=~" else ~hit
