"""Encoders and sinks, and the token index that stands in for per-file blooms."""

from __future__ import annotations

import base64
import json
import math
import ssl
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", block_bytes: int | None = None, bloom: list[str] | None = None, mode: str = "append") -> None:
    """Parquet with a codec (snappy, zstd, gzip or none), a row-group size, and whole-value blooms of columns."""
    w = df.write.mode(mode).option("compression", {"none": "uncompressed"}.get(compression, compression))
    if block_bytes:
        w = w.option("parquet.block.size", block_bytes)
    for c in bloom or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([a-zA-Z0-9]+)"), F.lit(1))


def ngrams(c: Column, n: int = 3) -> Column:
    """Runs of n code points of the lower-cased text; none if it is shorter. One pass: substring() at each place would walk the text from its start."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n items and false-positive chance p."""
    m = max(1, math.ceil(-max(n, 1) * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def bloom_bits(hash1: int, hash2: int, m: int, k: int) -> list[int]:
    """Double hashing: the bits of an item."""
    return [((hash1 + i * hash2) & ((1 << 64) - 1)) % m for i in range(k)]


def token_index(df: DataFrame, column: str = "message", file_col: Column | None = None) -> DataFrame:
    """(file, token): words and lower-cased trigrams of a column, distinct by file; a semi-join with it skips files."""
    file = file_col if file_col is not None else F.col("_metadata.file_path")
    tokens = F.array_distinct(F.concat(word_tokens(F.col(column)), ngrams(F.col(column))))
    return df.select(file.alias("file"), F.explode(tokens).alias("token")).distinct()


def files_with(index: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Files that may hold the text: those with all of its trigrams."""
    grams = sorted({text.lower()[i : i + n] for i in range(len(text) - n + 1)})
    if not grams:
        return index.select("file").distinct()
    return index.where(F.col("token").isin(grams)).groupBy("file").agg(F.count_distinct("token").alias("m")).where(F.col("m") == len(grams)).select("file")


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; NaN and infinities are null, and nulls are written."""
    safe = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(None)).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def json_array(df: DataFrame) -> DataFrame:
    """All rows as one JSON array (`value`), [] for none. Its size is that of the rows, so it is for windows and pages."""
    return json_rows(df).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))


def console(out=None, most_rows: int = 10_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that prints rows as JSON lines to standard output, most_rows of a window at most, and says how many more there are."""

    def batch(df: DataFrame, epoch: int) -> None:
        to = out or sys.stdout
        rows = json_rows(df).limit(most_rows + 1).collect()
        for r in rows[:most_rows]:
            print(r.value, file=to)
        if len(rows) > most_rows:
            print(f"... {df.count() - most_rows} more", file=to)

    return batch


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    json_rows(df).write.mode(mode).text(path)


def write_raw(df: DataFrame, path: str, mode: str = "append") -> None:
    """The first column as lines; null is an empty line."""
    df.select(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("")).alias("value")).write.mode(mode).text(path)


def to_arrow(df: DataFrame):
    """An Arrow table, for hand-over to a client; the caller bounds the rows."""
    return df.toArrow()


def from_arrow(spark: SparkSession, arrow_table) -> DataFrame:
    return spark.createDataFrame(arrow_table)


def read_lines(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """Lines of files as `value`, whole files or as a stream of new files; a window of the stream takes so many files or bytes at most."""
    if not stream:
        return spark.read.text(path)
    r = spark.readStream.format("text")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", bytes_per_trigger)
    return r.load(path)


def piped_lines(spark: SparkSession, source=None, most_lines: int = 10_000, most_bytes: int = 8 << 20) -> Iterator[DataFrame]:
    """Lines of standard input (or any iterable of text) as windows of so many lines or bytes at most; the last may be smaller."""
    held, size = [], 0
    for line in sys.stdin if source is None else source:
        line = line.rstrip("\n").removesuffix("\r")
        if held and (len(held) >= most_lines or size + len(line) > most_bytes):
            yield spark.createDataFrame([(x,) for x in held], "value string")
            held, size = [], 0
        held.append(line)
        size += len(line)
    if held:
        yield spark.createDataFrame([(x,) for x in held], "value string")


def sniff(head: bytes) -> str:
    """parquet, arrow (a stream), arrow-file, json or lines, by the first bytes."""
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"ARROW1"):
        return "arrow-file"
    if head.startswith(b"\xff\xff\xff\xff"):
        return "arrow"
    return "json" if head.lstrip()[:1] in (b"{", b"[") else "lines"


def import_window(spark: SparkSession, path: str) -> DataFrame:
    """A pushed window by its content, whatever its name: Parquet, Arrow IPC (stream or file), JSON (lines, or one array), or text lines. A folder is Parquet."""
    files = Files(spark)
    kind = "parquet" if files.is_folder(path) else sniff(files.head(path, 64))
    if kind.startswith("arrow"):
        import pyarrow as pa

        raw = pa.BufferReader(files.read_bytes(path))  # one window of a producer
        return spark.createDataFrame((pa.ipc.open_file if kind == "arrow-file" else pa.ipc.open_stream)(raw).read_all())
    if kind == "json":
        return spark.read.json(path, multiLine=files.head(path, 64).lstrip()[:1] == b"[")
    return spark.read.parquet(path) if kind == "parquet" else spark.read.text(path)


def post(url: str, body: bytes, headers: dict[str, str] | None = None, tries: int = 5, wait_s: float = 0.5, send: Callable | None = None) -> int:
    """POST with exponential waits; a 4xx other than 429 is final."""
    send = send or (lambda: urllib.request.urlopen(urllib.request.Request(url, body, headers or {}, method="POST"), timeout=30).status)
    for n in range(tries):
        try:
            return send()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429:
                raise
            if n == tries - 1:
                raise
        except urllib.error.URLError:
            if n == tries - 1:
                raise
        time.sleep(wait_s * 2**n)
    raise RuntimeError("unreachable")


def http_sink(url: str, most_rows: int = 10_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that posts JSON arrays from the executors, at most most_rows rows in each."""

    def batch(df: DataFrame, epoch: int) -> None:
        def send(rows):
            held: list = []
            for r in rows:
                held.append(json.loads(r.value))
                if len(held) >= most_rows:
                    post(url, json.dumps(held).encode(), {"Content-Type": "application/json"})
                    held = []
            if held:
                post(url, json.dumps(held).encode(), {"Content-Type": "application/json"})

        json_rows(df).foreachPartition(send)

    return batch


def fetch(url: str, access: dict[str, str] | None = None) -> str:
    """The text at a URL, with a bearer token or a user and password, over TLS with a CA of one's own or unchecked."""
    access = access or {}
    headers = {"Accept": "text/plain"}
    if "token" in access:
        headers["Authorization"] = f"Bearer {access['token']}"
    elif "user" in access:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{access['user']}:{access.get('password', '')}".encode()).decode()
    tls = None
    if url.startswith("https"):
        tls = ssl.create_default_context(cafile=access.get("ca_file"))
        if access.get("insecure", "").lower() == "true":
            tls.check_hostname, tls.verify_mode = False, ssl.CERT_NONE
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=10, context=tls).read().decode()


def scrape(target: str, get: Callable[[str], str] = fetch) -> list[str]:
    """Exposition lines of one target, and up, which tells whether it answered. A target that is down is a measurement."""
    try:
        return [*get(target).splitlines(), "up 1"]
    except Exception:
        return ["up 0"]
