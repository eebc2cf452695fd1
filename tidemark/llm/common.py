"""What the operators of this subpackage share: tables, checkpoints, a batch tokeniser."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Files, scratch_folder

#: Bytes of text that are tokenised at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18
#: Bytes of an Arrow batch that become Python objects at once.
PIECE_BYTES = 4 << 20
#: Bytes of a row group of intermediate tables, which a task holds while it writes.
ROW_GROUP = 8 << 20
#: Rows of an intermediate table of ids for which a file of its own pays, and files that are always allowed.
FILE_ROWS, LEAST_FILES = 50_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: While a table is written its shuffle files go with the job.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Sets the session to Arrow batches of 1,000 rows where it still has Spark's default of 10,000, which is too many whole texts at once for a worker's memory."""
    conf = df.sparkSession.conf
    if conf.get(_RECORDS, "10000") == "10000":
        conf.set(_RECORDS, "1000")
    return df


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again.

    The shuffle files behind it are deleted as soon as it is written, for nothing reads them any more. rows: about how many there are at
    most, where they are small; then no more tasks write than one for each FILE_ROWS, so that many shuffle partitions don't make many tiny files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(LEAST_FILES + rows // FILE_ROWS)
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that durable() wrote and that no later frame reads."""
    for t in tables:
        path = getattr(t, "_table", None)
        if path:
            Files(t.sparkSession).delete(path)


def temp_name(df: DataFrame, base: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


# --- words -----------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        m = 1 << max(16, (n - 1).bit_length())
        got = np.full(m, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if m <= 4 * BATCH_BYTES:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; salt picks one of many independent ones."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: runs of ASCII letters, digits and any non-ASCII
    code points, after A-Z are lower-cased.

    buf: the lower-cased bytes, with one 0 after each text. start, end: of each word
    in buf. first: for each text the index of its first word, and the number of words
    at the end. base: for each text its first byte in buf.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = _LOWER[np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8)]
        self.base = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=self.base[1:])
        inside = _WORD[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self._sums: np.ndarray | None = None

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte runs from start to end."""
        n = len(self.buf)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n + 1)[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * powers(_INVERSE, n + 1)[start])

    @property
    def hashes(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def hash_word(word: str) -> int:
    """The hash that Words gives this word."""
    return int(Words([word]).hashes[0])


def by_bytes(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a list into runs of about limit characters: (from, to)."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > limit:
            yield a, i
            a, n = i, 0
        n += len(t or "") + 1
    if a < len(texts):
        yield a, len(texts)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row; of all words if there are fewer; none if there are no words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j])
    return out


def rows_of(batches: Iterable, *names: str) -> Iterator[list[list]]:
    """Python lists of the named columns, for pieces of Arrow batches of about PIECE_BYTES, so that a batch of long texts isn't copied as a whole."""
    for b in batches:
        step = max(1, b.num_rows * PIECE_BYTES // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield [part.column(x).to_pylist() for x in names]
