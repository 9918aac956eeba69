"""What the operators share: tables, the shared folder, byte kernels, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
BATCH_BYTES = 1 << 22
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that travel between the JVM and Python by bytes (a longer row travels alone), and so what a
    task holds of its texts at once, however long documents are."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which hands the memory it has freed back to the system at its end: Spark keeps workers for further tasks, and what
    idle ones hold on to counts against their executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests) a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fieldspan-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/fieldspan-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder, once no result is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(shared_dir(spark)))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, n: int) -> list[str]:
    """n names that no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_x{i}" for i in range(n + len(taken))) if x not in taken][:n]


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size of df, from the files it reads; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def row_key(df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns to keep, with a key of two columns, doc_id and 64 bits of the text's hash: equal for
    rows that are equal in doc_id and text, so that neither null nor repeated doc_ids mix up rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"),
        F.xxhash64(text).alias("k2"),
        *[F.col(c).alias(f"_{c}") for c in keep],
    )


def kept_schema(df: DataFrame, keep: list[str] | tuple[str, ...]) -> str:
    return "".join(f", `_{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


# --- bytes -----------------------------------------------------------------------------------------


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts (one more entry than rows). Null: empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def row_chunks(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up, cls.down


class Rolling:
    """Hashes of any substring of a byte array in constant time (polynomial modulo 2^64, scrambled)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = Powers.to(n + 1)
        x = data.astype(np.uint64)
        x += np.uint64(1)
        x *= up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words_of(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes for which is_word[byte], never across rows, and how many words stand before each row (one more entry than rows)."""
    inside = is_word[data]
    n = len(data)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    if n:
        ends[:-1] &= ~inside[1:]
    first = at[:-1][at[:-1] < n]
    starts[first] |= inside[first]
    last = at[1:][at[1:] > 0] - 1
    ends[last] |= inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, at)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 23) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the keys: a table ends where a group ends, once it has `most` bytes. Larger
    batches are cut, so a table has little more than that, or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / 2 / max(batch.nbytes, 1)))
        for b in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
            if size >= most:
                t = pa.Table.from_batches([*held, b])
                cut = _last_group(t, keys)
                if cut:
                    yield t.slice(0, cut)
                    rest = t.slice(cut).combine_chunks()
                    held = rest.to_batches()
                    size = sum(x.nbytes for x in held)
                    continue
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _last_group(t: pa.Table, keys: list[str]) -> int:
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        x = t[k].combine_chunks().to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(change)
    return int(at[-1]) if len(at) else 0


def u64(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# --- graphs ----------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of a partition, so that dense groups shrink before they are shuffled: each node with
    the smallest it is connected with, as far as this task has seen."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:
            yield out()
    yield out()


#: Up to so many edges of a forest are connected by one task.
FEW_EDGES = 1 << 18


def components(edges: DataFrame, few: int = FEW_EDGES, sparse: bool = False) -> DataFrame:
    """node, comp: the smallest node of the connected component of each node of edges (a long, b long).

    Where forests of the partitions have few edges together, one task connects them. Else alternates large-star and
    small-star steps until nothing changes; each step is written to the shared
    folder, so neither the driver nor a task holds more than a spanning forest of one partition. Hot
    nodes are pre-aggregated: a step needs only the minimum over a node's neighbours. sparse: the edges are no more than a
    few times the nodes, so that a forest of each partition would save little."""
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = materialize(e if sparse else e.mapInArrow(lean(_forest), "a long, b long"))
    named = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    if e.limit(few + 1).count() <= few:
        # two nodes an edge at most, so the task doesn't pass anything on before its end
        return named(e.coalesce(1).mapInArrow(lean(lambda batches: _forest(batches, 2 * few + 1)), "a long, b long"))
    before = None
    for _ in range(64):
        for large in (True, False):
            if large:
                both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            else:
                both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            j = both.join(least, "a")
            if large:
                e = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                e = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            e = e.where("a <> b").distinct()
        e = materialize(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return named(e)
