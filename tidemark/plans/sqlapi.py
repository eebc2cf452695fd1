"""Read-only SQL over a tenant's views: a parser-based check, a dialect shim, a row cap."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_CAP = 10_000


class SQLError(ValueError):
    pass


_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def _outside_literals(text: str, f) -> str:
    out, at = [], 0
    for m in _LITERAL.finditer(text):
        out += [f(text[at : m.start()]), " " if m[0][:2] in ("--", "/*") else m[0]]
        at = m.end()
    return "".join([*out, f(text[at:])])


def _call(text: str, name: str, render) -> str:
    """Rewrites name(a, b, ..) with balanced parentheses; arguments may hold literals."""
    at = 0
    pattern = re.compile(rf"\b{name}\s*\(", re.I)
    while m := pattern.search(text, at):
        depth, i, args, start = 1, m.end(), [], m.end()
        while depth:
            if i >= len(text):
                raise SQLError(f"unbalanced parentheses after {name}")
            lit = _LITERAL.match(text, i)
            if lit:
                i = lit.end()
                continue
            c = text[i]
            depth += (c in "([") - (c in ")]")
            if (c == "," and depth == 1) or not depth:
                args.append(text[start:i].strip())
                start = i + 1
            i += 1
        new = render(*args)
        text = text[: m.start()] + new + text[i:]
        at = m.start() + 1
    return text


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
#: Buckets count from this Monday, 2000-01-03, in seconds since the epoch.
ORIGIN = 946_857_600


def _bucket(width: str, ts: str) -> str:
    """time_bucket(INTERVAL '5 minutes', ts) as the start of a window with the same origin."""
    m = re.fullmatch(r"(?i)interval\s+'?\s*(\d+)\s*([a-z]+?)s?\s*'?(?:\s*([a-z]+?)s?)?", width.strip())
    unit = (m[3] or m[2]).lower() if m else ""
    if unit not in _UNIT_SECONDS:
        raise SQLError(f"bad bucket width {width}")
    seconds = int(m[1]) * _UNIT_SECONDS[unit]
    return f"window({ts}, '{seconds} seconds', '{seconds} seconds', '{ORIGIN % seconds} seconds').start"


#: The codes of strftime as letters of a date pattern.
_STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD"}
#: Functions that differ by name only.
_NAMES = {"list_contains": "array_contains", "list_distinct": "array_distinct", "list_value": "array", "list_concat": "concat", "list_position": "array_position", "list_reverse": "reverse", "arg_max": "max_by", "arg_min": "min_by", "quantile_cont": "percentile", "list_has_any": "arrays_overlap", "strlen": "octet_length", "string_agg": "listagg"}
_UNITS = {"second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def _strftime(ts: str, form: str) -> str:
    m = re.fullmatch(r"'((?:[^']|'')*)'", form.strip())
    if not m:
        raise SQLError("strftime needs a literal format")
    out, at = "", 0
    for code in re.finditer(r"%(.)", m[1]):
        plain = m[1][at : code.start()]
        out += re.sub(r"[A-Za-z]+", lambda w: f"''{w[0]}''", plain)
        if code[1] == "%":
            out += "%"
        elif code[1] in _STRFTIME:
            out += _STRFTIME[code[1]]
        else:
            raise SQLError(f"strftime code %{code[1]} isn't known")
        at = code.end()
    out += re.sub(r"[A-Za-z]+", lambda w: f"''{w[0]}''", m[1][at:])
    return f"date_format({ts}, '{out}')"


def _date_diff(unit: str, start: str, end: str) -> str:
    """The number of boundaries of a unit between two times."""
    name = unit.strip().strip("'").lower().rstrip("s")
    if name not in _UNITS:
        raise SQLError(f"bad unit {unit}")
    return f"timestampdiff({name.upper()}, date_trunc('{name}', {start}), date_trunc('{name}', {end}))"


def translate(sql: str) -> str:
    """Spellings of the store's dialect in Spark SQL."""

    def words(part: str) -> str:
        part = re.sub(r"\bEXCLUDE\b\s*\(", "EXCEPT (", part, flags=re.I)
        part = re.sub(r"\bVARCHAR\b(?!\s*\()", "STRING", part, flags=re.I)
        return part.replace("//", " div ")

    text = _outside_literals(sql, words)
    text = _call(text, "epoch_ms", lambda a: f"unix_millis(cast({a} as timestamp))")
    text = _call(text, "epoch_us", lambda a: f"unix_micros(cast({a} as timestamp))")
    text = _call(text, "epoch", lambda a: f"(unix_micros(cast({a} as timestamp)) / 1000000D)")
    text = _call(text, "make_timestamp", lambda a: f"timestamp_micros({a})")
    text = _call(text, "regexp_full_match", lambda a, p: f"regexp_like({a}, concat('^(?:', {p}, ')$'))")
    text = _call(text, "regexp_matches", lambda a, p: f"regexp_like({a}, {p})")
    text = _call(text, "string_split", lambda a, p: f"split({a}, concat('\\\\Q', {p}, '\\\\E'))")
    text = _call(text, "list_sort", lambda a: f"sort_array({a})")
    text = _call(text, "quantile_disc", lambda a, q: f"percentile_disc({q}) WITHIN GROUP (ORDER BY {a})")
    text = _call(text, "strftime", _strftime)
    text = _call(text, "date_diff", _date_diff)
    text = _call(text, "time_bucket", _bucket)
    for name, own in _NAMES.items():
        text = _call(text, name, lambda *args, own=own: f"{own}({', '.join(args)})")
    return _qualify(text)


def _qualify(text: str) -> str:
    """SELECT .. QUALIFY p at the top level as a filter around the query."""
    m = re.search(r"\bQUALIFY\b", _outside_literals(text, lambda s: s), re.I)
    if not m:
        return text
    head, tail = text[: m.start()], text[m.end() :]
    order = re.search(r"\b(ORDER\s+BY|LIMIT)\b(?!.*\))", tail, re.I | re.S)
    cond, rest = (tail[: order.start()], tail[order.start() :]) if order else (tail, "")
    top = re.match(r"\s*SELECT\s", head, re.I)
    if not top:
        raise SQLError("QUALIFY is supported in a plain SELECT")
    inner = head[: top.end()] + f"({cond.strip()}) AS qualify_, " + head[top.end() :]
    return f"SELECT * EXCEPT (qualify_) FROM ({inner}) WHERE qualify_ {rest}"


def _seq(xs):
    return [xs.apply(i) for i in range(xs.length())]


def _nodes(plan):
    """A logical plan's nodes, those in subqueries and CTEs included."""
    yield plan
    for sub in ("children", "innerChildren", "subqueries"):
        for x in _seq(getattr(plan, sub)()):
            if hasattr(x, "children") and hasattr(x, "subqueries"):
                yield from _nodes(x)


def _expressions(e):
    yield e
    for x in _seq(e.children()):
        yield from _expressions(x)


#: Table functions that only make rows from their arguments.
_GENERATORS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "sequence"}
#: Built-in functions that run other code, read files or tell about the host, the session or its user.
_REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "from_avro", "to_avro", "schema_of_avro", "from_protobuf", "to_protobuf", "current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "version", "spark_partition_id"}


def _allowed_functions(spark: SparkSession) -> set[str]:
    """Spark's own functions without those refused; functions that somebody registered aren't among them."""
    got = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet().mkString(",")
    return {str(x).strip("`").split(".")[-1].strip("`").lower() for x in str(got).split(",")} - _REFUSED


def check_read_only(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Raises unless sql is one query over the given views with allowed functions.

    Spark's own parser decides, so a ; in a string, column lists of CTEs and quoted identifiers are
    no trouble; commands, writes below a WITH, files as relations and other views are refused. Functions are taken from the parsed
    expressions, whatever their case, quotes or place (select list, lateral view, FROM), and must be on the list of allowed ones.
    """
    sessions = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)  # the parser reads this thread's settings
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SQLError(next(filter(str.strip, str(e).splitlines()), "bad SQL")) from e
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
    bad = re.compile(r"Command|Insert|CreateTable|CreateView|Create|Drop|Alter|Delete|Update|Merge|SetCatalog|SetNamespace|UseStatement|Refresh|Cache|Uncache|Load|Truncate|Analyze|Describe|Show|Script")
    names: set[str] = set()
    cte: set[str] = set()
    functions: set[str] = set()
    tables: set[str] = set()
    for n in _nodes(plan):
        kind = n.getClass().getSimpleName()
        if bad.search(kind):
            raise SQLError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            cte |= {str(x._1()).lower() for x in _seq(n.cteRelations())}
        if kind == "UnresolvedRelation":
            names.add(".".join(map(str, _seq(n.multipartIdentifier()))).lower())
        if kind == "UnresolvedTableValuedFunction":
            tables.add(".".join(map(str, _seq(n.name()))).lower())
        for top in _seq(n.expressions()):
            for e in _expressions(top):
                what = e.getClass().getSimpleName()
                if what == "UnresolvedFunction":
                    functions.add(".".join(map(str, _seq(e.nameParts()))).lower())
                elif what == "UnresolvedGenerator":
                    tables.add(str(e.name().funcName()).lower())
                elif what in ("CallMethodViaReflection", "InputFileName"):
                    functions.add(what)
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan.toString()):
        names.add(name.replace(", ", ".").lower())
    unknown = names - {v.lower() for v in views} - cte
    if unknown:
        raise SQLError(f"unknown relations: {', '.join(sorted(unknown))}")
    if tables - _GENERATORS:
        raise SQLError(f"table functions are limited to generators, without {', '.join(sorted(tables - _GENERATORS))}")
    refused = functions - _allowed_functions(spark)
    if refused:
        raise SQLError(f"functions that aren't allowed: {', '.join(sorted(refused))}")


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings and a catalog of its own, so that views of two queries never meet."""
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], row_cap: int | None = ROW_CAP) -> DataFrame:
    """A query over views, at most row_cap + 1 rows: one more than the cap tells that it was truncated. None: all rows.

    Each query runs in a session of its own: its views and its parser settings are seen by no other query, and the
    caller's views of the same names stay as they are.
    """
    text = translate(sql).strip().rstrip(";")
    own = _own_session(spark)
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    check_read_only(own, text, set(views))
    for name, df in views.items():
        spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    out = own.sql(text)
    return out if row_cap is None else out.limit(row_cap + 1)


def page(df: DataFrame, row_cap: int = ROW_CAP) -> tuple[list, bool]:
    """(rows, truncated) of run_sql's result."""
    rows = df.collect()  # at most row_cap + 1
    return rows[:row_cap], len(rows) > row_cap


def json_cell(c: F.Column, kind: str) -> F.Column:
    """A cell as the JSON answer writes it: RFC 3339 times, text for bytes, else the value."""
    if kind.startswith("timestamp"):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return c.cast("string") if kind == "binary" else c
