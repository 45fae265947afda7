"""What the operators of this subpackage share: intermediate tables, word hashes, safe column handling."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six (as a Java regular expression).
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\r\x0b\x0c"
U64 = np.uint64
MIX = 0x9E3779B97F4A7C15


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary folder of our own only in a local session that names
    none; on a cluster, naming none is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='quarry-')}")
    return named or sc.getCheckpointDir().rsplit("/", 1)[0]


#: Rows of an Arrow batch while operators run: whole texts travel in them, in the JVM and in Python workers alike.
ARROW_ROWS = 1_000


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, most: int) -> Iterator[None]:
    """A limit of the session, lowered to this for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> contextlib.AbstractContextManager[None]:
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


class Scratch:
    """Tables that cut lineage: written once as Parquet in the shared folder, dropped when no longer needed. As a
    context, all of them go if the operator fails."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            self.remove()

    def keep(self, df: DataFrame, name: str, rows: int = ARROW_ROWS) -> DataFrame:
        """rows: of an Arrow batch, more for tables without texts."""
        path = f"{self.path}/{name}"
        with arrow_rows(self.spark, rows):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
        """A checkpoint of df; all other tables go. Spark deletes checkpoints that nothing refers to any more if the
        session sets spark.cleaner.referenceTracking.cleanCheckpoints."""
        with arrow_rows(self.spark, rows):
            out = df.checkpoint()
        self.remove()
        return out


def release() -> None:
    """Gives memory that this worker no longer needs back to the system: it may wait for its next task beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable) -> Callable:
    """A function for mapInArrow or mapInPandas that releases memory when its task ends."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly these columns, named and cast: pick(df, doc_id="long", text="string"). Extra columns go, so none can
    clash; a column that df lacks is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[k.lower()]}`") if k.lower() in have else F.lit(None)).cast(t).alias(k) for k, t in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STRETCH = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MIX^i and MIX^-i modulo 2^64 for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(MIX, -1, 1 << 64)
        size = max(n, _STRETCH + 4096)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, m, dtype=U64)))) for m in (MIX, inverse)]
    return _POWERS[0], _POWERS[1]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 text, and where they start. Works on stretches cut at white space, so memory
    stays bounded however long the text is; a hash depends on its word alone."""
    hashes, starts, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    whole = np.frombuffer(data, dtype=np.uint8)
    while at < len(whole):
        end = min(len(whole), at + _STRETCH)
        while end < len(whole) and not _SPACE[whole[end]]:
            stop = min(len(whole), end + 4096)
            gap = np.flatnonzero(_SPACE[whole[end:stop]])
            end = end + int(gap[0]) if len(gap) else stop
        part = whole[at:end]
        edge = np.diff(np.concatenate(([True], _SPACE[part], [True])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(len(part) + 1)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], dtype=U64)))
        hashes.append(finalise((sums[last] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def lazily(column, rows: int = 256) -> Iterator:
    """The values of an Arrow column as Python objects, few at a time, so that a batch is never held twice."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def hashed_texts(texts: Iterable[str | None], lower: bool = False, size: int = 1 << 19) -> Iterator[np.ndarray]:
    """The word hashes of every text, in order, computed for many short texts at once."""
    group: list[bytes] = []

    def done() -> Iterator[np.ndarray]:
        data = b"\n".join(group) + b"\n"
        h, starts = hash_words(data.lower() if lower else data)
        ends = np.cumsum([len(x) + 1 for x in group])
        yield from np.split(h, np.searchsorted(starts, ends)[:-1])

    held = 0
    for t in texts:
        group.append(encode(t))
        held += len(group[-1])
        if held >= size:
            yield from done()
            group, held = [], 0
    if group:
        yield from done()


def finalise(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: spreads all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint of every run of n words, by polynomial hashing modulo 2^64 and a finaliser."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(m, dtype=U64)
    for k in range(n):
        out = out * U64(MIX) + hashes[k : k + m]
    return finalise(out)


def long_ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ngrams(), in few passes for large n: doubling, then one combination of two overlapping runs."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    w, run = 1, hashes
    while 2 * w <= n:
        run = finalise(run[: len(run) - w] * U64(MIX) + run[w:])
        w *= 2
    return finalise(run[:m] * U64(0xC2B2AE3D27D4EB4F) + run[n - w : n - w + m]) if w < n else run[:m]


#: Ids up to this number may be broadcast (8 bytes each); beyond it, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """df, to be broadcast if it is a kept table of at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df
