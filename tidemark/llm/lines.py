"""Line dedup within an edit bound, by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, temp_name

#: Default of near_chars: lines under this many code points are removed only as exact copies; 0 is no floor.
NEAR_CHARS = 16
#: Lines of a text, by and large.
LINES = 20
_PLACE = ["k", "th", "ln"]


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, th, lines) of each row: its id (the least long for null), a hash of its text, its lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))


def first_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct line (ends trimmed, not blank): hashes, length, half keys and first place.

    Only hashes are shuffled. A line of n code points has the half keys of the classes n and
    n - 1: class c joins lines of c and c + 1 code points, of which one edit leaves
    the first or the last floor(c / 2) alike.
    """
    rows = _places(docs, id_col, text_col).select("k", "th", F.posexplode("lines").alias("ln", "raw"))
    rows = rows.select("k", "th", "ln", F.trim(F.regexp_replace("raw", "\r$", "")).alias("line")).where("line <> ''").withColumn("n", F.char_length("line"))
    half = lambda c, side: F.expr(f"xxhash64({side}, {c} div 2, {'left' if side == 0 else 'right'}(line, {c} div 2))")
    rows = rows.select(*_PLACE, "n", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), half("n", 0).alias("a0"), half("n", 1).alias("a1"), half("(n - 1)", 0).alias("b0"), half("(n - 1)", 1).alias("b1"))
    keep = ["n", "a0", "a1", "b0", "b1"]
    return rows.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("p"), *[F.min(c).alias(c) for c in keep])


def _candidates(firsts: DataFrame, near_chars: int) -> DataFrame:
    """(k, th, ln, c, side) of lines of which another has the same half: the edit, if there is one, is in the other half."""
    half = lambda c, side, key: F.struct(F.expr(c).alias("c"), F.lit(side).alias("side"), F.col(key).alias("key"))
    keyed = firsts.where(F.col("n") >= near_chars).select("p", F.explode(F.array(half("n", 0, "a0"), half("n", 1, "a1"), half("n - 1", 0, "b0"), half("n - 1", 1, "b1"))).alias("s")).select("p.*", "s.*").where("c > 0")
    multi = keyed.groupBy("key", "c").count().where("count > 1").select("key", "c")
    return keyed.join(multi, ["key", "c"], "left_semi").select(*_PLACE, "c", "side")


def _middles(docs: DataFrame, candidates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Candidate lines cut into a beginning, a middle of about sqrt(c) code points in the half that may differ, and an end.

    key: a 128-bit hash of all but the middle. plus: the line has c + 1 code points.
    """
    per_doc = candidates.groupBy("k", "th").agg(F.collect_list(F.struct("ln", "c", "side")).alias("want"))
    rows = _places(docs, id_col, text_col).dropDuplicates(["k", "th"]).join(per_doc, ["k", "th"])
    rows = rows.select("k", "th", "lines", F.explode("want").alias("w")).select("k", "th", "w.*", F.expr("trim(regexp_replace(element_at(lines, w.ln + 1), '\\r$', ''))").alias("line"))
    rows = rows.withColumn("n", F.char_length("line")).withColumn("b", F.ceil(F.sqrt("c")).cast("int"))
    # With an equal first half (side 0) the blocks from it on, else those up to the last half.
    first = F.when(F.col("side") == 0, F.expr("(c div 2) div b")).otherwise(F.lit(0))
    last = F.when(F.col("side") == 0, F.expr("(c - 1) div b")).otherwise(F.expr("least((c - 1) div b, (c - c div 2) div b)"))
    rows = rows.withColumn("i", F.explode(F.sequence(first, last))).withColumn("from", F.col("i") * F.col("b")).withColumn("rest", F.expr("greatest(c - from - b, 0)"))
    head, tail = F.expr("left(line, from)"), F.expr("right(line, rest)")
    return rows.select(*_PLACE, "c", "i", (F.col("n") > F.col("c")).alias("plus"), F.xxhash64(F.lit(1), "c", "i", head, tail).alias("k1"), F.xxhash64(F.lit(2), "c", "i", head, tail).alias("k2"), F.expr("substring(line, from + 1, n - from - rest)").alias("mid")).distinct()


def near_copies(docs: DataFrame, firsts: DataFrame, n: int | None = None, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, th, ln) of first places of lines with an earlier line at edit distance 1.

    Candidates are lines that share a half with another line, and then all but a
    short middle; both are necessary for one edit, so nothing is lost. Of
    the middle, all variants within the bound are emitted as hashed keys: each deletion with its
    place (two lines that meet there differ by a substitution), and for lines of c + 1 code points each
    deletion against the whole middle of those of c. Lines with equal variants are joined
    with the earliest of them only, and the edit distance is verified.
    """
    written = durable(_middles(docs, _candidates(firsts, near_chars), id_col, text_col), n)
    key = ["k1", "k2", "c", "i"]
    multi = written.groupBy(*key).count().where("count > 1").select(*key)
    mids = written.join(multi, key, "left_semi").withColumn("size", F.char_length("mid")).where("size > 0")
    without = F.expr("transform(sequence(1, size), j -> struct(IF(plus, 0, j) AS at, xxhash64(left(mid, j - 1), substring(mid, j + 1)) AS v1, concat(left(mid, j - 1), substring(mid, j + 1)) AS v))")
    variants = F.when(F.col("plus"), F.array_distinct(without)).otherwise(F.concat(without, F.expr("array(struct(0 AS at, xxhash64(mid, '') AS v1, mid AS v))")))
    rows = mids.select(*key, *_PLACE, "plus", "mid", F.explode(variants).alias("s")).select(*key, *_PLACE, "plus", "mid", "s.at", F.xxhash64("s.v").alias("v"))
    group = [*key, "at", "v"]
    me = F.struct(*_PLACE, "mid")
    # Groups at 0 hold lines of c code points and of c + 1, which are partners of the other kind only.
    other = rows.groupBy(*group).agg(F.min(F.when(~F.col("plus"), me)).alias("same"), F.min(F.when(F.col("plus"), me)).alias("longer"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = rows.join(other, group).withColumn("partner", F.when((F.col("at") == 0) & ~F.col("plus"), F.col("longer")).otherwise(F.col("same")))
    earlier = F.struct(*_PLACE) > F.struct("partner.k", "partner.th", "partner.ln")
    out = durable(met.where("partner is not null").where(earlier).where(F.levenshtein("mid", "partner.mid", 1).between(0, 1)).select(*_PLACE).distinct(), n)
    discard(written)
    return out


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each line for which an earlier one, by (id, line number), is equal or within edit distance 1.

    Lines end at \\n; blanks at their ends (and a final \\r) don't count in the comparison, and
    blank lines stay. The bound is one edit, no other works. Lines under near_chars code points are removed only as exact copies, for in
    so short a line one edit often makes another entry or number; 0 compares lines of any length. Equal lines
    are grouped by 128-bit hashes. An earlier line counts whether it stays or not.

    Returns all columns of docs with the text replaced by the lines that stay, joined by \\n, and n_lines and
    n_removed (named with trailing _ if docs has such columns). A null text stays null, with 0 lines; an
    empty one has 1 blank line. Null ids come first. Of repeated rows (equal id and text) the first that is read keeps lines, the others are
    copies and keep only blank ones. A frequent line is counted map-side and never gathered in a task.
    """
    k, th, lines, keep, uid, first = (temp_name(docs, x) for x in ("k", "th", "lines", "stay", "uid", "first"))
    columns = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = lambda df: df.withColumn(k, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))).withColumn(th, F.xxhash64(text))
    repeated = not keyed(docs).groupBy(k, th).count().where("count > 1").isEmpty()
    if repeated:
        docs = durable(docs.withColumn(uid, F.monotonically_increasing_id()))  # written, so that numbers are the same in each pass
    n = LINES * docs.count()
    firsts = durable(first_places(docs, id_col, text_col).where("n is not null"), n)
    gone = near_copies(docs, firsts, n, near_chars, id_col, text_col)
    stay = firsts.select("p.*").join(gone, _PLACE, "left_anti").groupBy("k", "th").agg(F.collect_list("ln").alias("stay"))
    rows = keyed(docs)
    kept = F.col(keep)
    if repeated:
        least = durable(rows.groupBy(k, th).agg(F.min(uid).alias(first), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
        rows = rows.join(least, [k, th], "left")
        kept = F.when(F.col(first).isNull() | (F.col(uid) == F.col(first)), kept)
    rows = rows.join(stay.select(F.col("k").alias(k), F.col("th").alias(th), F.col("stay").alias(keep)), [k, th], "left").withColumn(lines, F.split(text, "\n"))
    blank = F.expr(f"filter(transform(`{lines}`, (x, i) -> IF(trim(regexp_replace(x, '\\r$', '')) = '', i, NULL)), i -> i IS NOT NULL)")
    order = F.array_sort(F.concat(F.coalesce(kept, F.expr("cast(array() as array<int>)")), blank))
    rows = rows.withColumn(keep, order)
    n_lines, n_removed = temp_name(docs, "n_lines"), temp_name(docs, "n_removed")
    new = F.array_join(F.transform(F.col(keep), lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    null = F.col(f"`{text_col}`").isNull()
    out = [F.when(~null, new).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns]
    size = F.when(null, 0).otherwise(F.size(lines)).cast("long")
    return rows.select(*out, size.alias(n_lines), F.when(null, 0).otherwise(F.size(lines) - F.size(keep)).cast("long").alias(n_removed))
