"""What the operators of this subpackage share: tables, the shared folder, flat views of text
columns, vectorised hashing, and connected components.

Conventions that hold for every operator here, unless its docstring says otherwise:

* a null text is an empty text; a null id is kept as a null id;
* an operator reads the columns it is told to read and returns its own columns only, so further
  columns of the input, whatever their names, neither clash nor pass through;
* repeated rows give repeated results; an empty table gives an empty result of the same schema;
* texts are processed whole. One chunk holds whole documents up to ``CHUNK_BYTES``, or one longer
  document, so memory is bounded by the longest document.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes.
CHUNK_BYTES = 4 << 20
#: Hashes that a worker remembers so as not to send a thing twice (some 70 bytes each); forgetting costs rows, not results.
KNOWN = 200_000
#: A word is a maximal run of other characters than these six.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE_BYTES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where there is one machine, a folder of our own stands for an unset one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="colometry-"))
        found = _OWN_DIR[0]
    return found.rstrip("/")


#: The folder of local mode, once made.
_OWN_DIR: list[str] = []


#: Paths stashed since each open `scratch` began.
_SCRATCH: list[list[str]] = []


def stash(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors.

    The files go when the `scratch` around it ends, else when the application does. The shuffle files of
    the write go at its end, not when the driver happens to collect its garbage, so they don't add up.
    """
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    for paths in _SCRATCH:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


#: Spark's setting by which a query's shuffle files are removed as it ends. A write is a query of its own, which nothing runs again.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame | None], DataFrame | None]]:
    """Deletes what is stashed within, but for what the function it gives is called with.

    What is kept must not be read from what goes: all but the stash itself.
    """
    own: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame | None) -> DataFrame | None:
        if df is not None:
            kept.add(df._stash)
        return df

    _SCRATCH.append(own)
    try:
        yield keep
    finally:
        _SCRATCH.remove(own)
        for path in own:
            if path not in kept:
                where, files = _files(spark, path)
                files.delete(where, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose worker gives memory back to the system after each task: workers outlive tasks, and
    what idle ones hold is lacking elsewhere in the executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            settle()

    return df.mapInArrow(task, schema)


def settle() -> None:
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


# ---------------------------------------------------------------- flat text


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and each text's bounds (length + 1). Null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) for runs of rows whose texts together have at most limit bytes, or one row."""
    for batch in batches:
        data, bounds = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at), data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
            at = end


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the flat bytes, and for each text the bounds of its words."""
    word = _IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


# ---------------------------------------------------------------- hashing

_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        held = (out[0], out[1])
        if size <= 1 << 24:
            _POWERS[base] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (MurmurHash3's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """S with S[i] = sum of (value + 1) * base**j over j < i, for polynomial hashes of any range."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[lo:hi], the same wherever the range lies."""
    return mix((sums[hi] - sums[lo]) * powers(base, len(sums))[1][lo] + (hi - lo).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_sums(data), starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, texts' bounds ignored; empty if there are fewer."""
    at = np.arange(max(0, len(words) - n + 1))
    return range_hash(prefix_sums(words, _GRAM), at, at + n, _GRAM)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


# ---------------------------------------------------------------- connected components


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step hangs neighbours
    on the smallest one until only stars are left, so the number of rounds grows with the logarithm of the diameter and a
    round moves at most the edges there are. The minimum is a combined aggregate joined back, so a
    node with very many edges meets no single task but in a splittable join.
    """

    def hang(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v")
        if large:
            both = both.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = stash(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        now = stash(spark, hang(hang(now, True), False))
        # done when all are stars: each node hangs on one other, on which no more hangs than leaves
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def merged(spark: SparkSession, comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components (c, comp) after more links (a, b). Nodes that comps lacks are alone; None: all are."""
    if links.isEmpty():
        return comps
    if comps is None:
        return stash(spark, components(spark, links).select(F.col("node").alias("c"), F.col("component").alias("comp")))
    for end in ("a", "b"):
        at = comps.select(F.col("c").alias(end), F.col("comp").alias("at"))
        links = links.join(at, end, "left").withColumn(end, F.coalesce("at", end)).drop("at")
    moved = components(spark, links).select(F.col("node").alias("comp"), F.col("component").alias("now"))
    old = comps.join(moved, "comp", "left").select("c", F.coalesce("now", "comp").alias("comp"))
    new = moved.join(comps.select(F.col("c").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("c"), F.col("now").alias("comp"))
    return stash(spark, old.union(new))


def fold32(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 4; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
