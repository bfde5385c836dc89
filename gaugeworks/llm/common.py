"""Shared helpers: tables in the shared folder, word patterns, and numpy views of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_begun: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _own:
            _own[name] = tempfile.mkdtemp(prefix="gaugeworks-")
        where = _own[name]
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. What an application wrote goes when its driver ends, or by `dropped`."""
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/gw-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if own not in _begun:  # once it is there
        p, files = _path(spark, own)
        files.deleteOnExit(p)
        _begun.add(own)
    relieve()  # frames in reference cycles hold plans, and their broadcasts, in the driver's JVM
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables that `written` made and that no plan needs any more."""
    for df in frames:
        p, files = _path(df.sparkSession, df.written_to)
        files.delete(p, True)


# ---- rows with columns of any name -------------------------------------------------------------


def wrapped(docs: DataFrame, keep: list[str] | None = None, **own: Column) -> DataFrame:
    """The row (or what is to be kept of it) as one struct row_, and an operator's own columns beside it: no name of the input can clash with them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in (keep or docs.columns)]).alias("row_"), *[c.alias(n) for n, c in own.items()])


def unwrapped(df: DataFrame, *own: str, put: dict[str, Column] | None = None) -> DataFrame:
    """The input's columns again (those in `put` replaced), then the operator's own; of equal names (in any case) only the operator's stays."""
    put, mine = put or {}, {n.lower() for n in own}
    names = df.schema["row_"].dataType.names
    return df.select(*[put[n].alias(n) if n in put else F.col("row_")[n].alias(n) for n in names if n.lower() not in mine], *own)


def broadcast_if_small(df: DataFrame, rows: int = 200_000, held: Column | None = None) -> DataFrame:
    """Hint a broadcast only when a count proves the table small; beyond that Spark shuffles both sides. held: what a row counts for, if it holds an array."""
    n = df.limit(rows + 1).count() if held is None else df.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


BITS = 1 << 28  # 32 MB at most


def may_hold(df: DataFrame, key: Column, some: DataFrame, value: Column) -> DataFrame:
    """df with may_: false only where no row of `some` has this key's value. A bitmap of the values' hashes is broadcast, some 2 bytes a value, so the rows are not shuffled; what may_ lets through is for an exact join."""
    bits = max(1 << 15, min(BITS, 1 << (16 * some.count()).bit_length()))
    place, other = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(value), F.lit(bits))
    marks = some.select(F.shiftright(other, 15).alias("bucket_"), other.bitwiseAND(32767).alias("at_")).groupBy("bucket_").agg(F.bitmap_construct_agg("at_").alias("marks_"))
    out = df.withColumn("place_", place).withColumn("bucket_", F.shiftright("place_", 15)).join(F.broadcast(marks), "bucket_", "left")
    byte = F.conv(F.hex(F.expr("substring(marks_, cast((place_ & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(place_ & 7 as int))")) != 0, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], may.alias("may_"))


SHARE = 2000  # a key of more than one in SHARE rows (and more than 64) is hot: there are fewer than SHARE such keys, whatever the table


def hot_limit(df: DataFrame) -> int:
    return max(64, df.count() // SHARE)


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left.join(right, key, how), inner or left, where a key may hold a third of the left rows and is at most once on the right.

    The rows of hot keys meet a broadcast; in the shuffle for the others they, and rows with a null key, are spread
    by their content and meet nothing. hot: the keys of more than hot_limit(left) rows, where the caller has counted them.
    """
    keys = [key] if isinstance(key, str) else key
    if hot is None:
        hot = left.groupBy(*keys).agg(F.count("*").alias("rows_")).where(F.col("rows_") > hot_limit(left))
    hot = written(hot.select(*keys))
    more = [c for c in right.columns if c not in keys]
    if hot.isEmpty() and how == "inner":
        return left.join(right, keys, how)
    value = F.struct(F.lit(True).alias("met_"), *more)
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi").select(*keys, value.alias("hot_")))
    cold = F.col("hot_").isNull() & reduce(and_, [F.col(k).isNotNull() for k in keys])
    spread = F.when(cold, 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 30)))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))  # no literal, which would be no key of the shuffle
    rest = right.select(*keys, value.alias("cold_"), zero.cast("long").alias("spread_"))
    out = left.join(few, keys, "left").withColumn("spread_", spread.cast("long")).join(rest, [*keys, "spread_"], "left")
    out = out.withColumn("hot_", F.coalesce("hot_", "cold_"))
    if how == "inner":
        out = out.where("hot_ is not null")
    return out.select(*left.columns, *[F.col("hot_")[c].alias(c) for c in more])


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers from the driver, made in the JVM: no Python worker reads it."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(x.split()) for x in schema.split(','))}>>")))


def running(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """df with each column's sum over all rows before in the (unique) order, without one task for all rows: ranges, sums inside, then offsets.

    A row for each range (as many as shuffle partitions) comes to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.select("*", *[c.alias(k) for k, c in sums.items()]).repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()))
    at, rows = dict.fromkeys(sums, 0), []
    for r in sorted(cut.groupBy("range_").agg(*[F.sum(k).alias(k) for k in sums]).collect(), key=lambda r: r["range_"]):
        rows.append((r["range_"], *at.values()))
        at = {k: v + (r[k] or 0) for k, v in at.items()}
    kinds = dict(cut.dtypes)
    starts = local_rows(spark, rows, "range_ int" + "".join(f", {k}_ {'double' if kinds[k] == 'double' else 'long'}" for k in sums))
    before = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("*", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_in") for k in sums])
    return inside.join(F.broadcast(starts), "range_").select(*df.columns, *[(F.col(f"{k}_in") + F.col(f"{k}_")).alias(k) for k in sums])


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound the Arrow batches that reach Python, by rows and by bytes: documents may be very long. The session keeps these bounds, since plans run later; they change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def collected(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects what refers to them, which a heap that is not full puts off: ask for it after a step that shuffled much."""
    gc.collect()
    spark._jvm.System.gc()


def executors_relieved(spark: SparkSession) -> None:
    """The executors' heaps give back what earlier steps grew: each collects its garbage once, and a heap that is mostly free shrinks.

    A heap grows to its limit while tasks sort and shuffle, and stays so beside the Python workers of later steps. A task
    for each core, so that each executor gets one (if it is busy elsewhere, it keeps its heap; no result changes).
    """
    collected(spark)
    n = 1 if re.match(r"local(\[|$)", spark.sparkContext.master) else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where("reflect('java.lang.System', 'gc') is not null").write.format("noop").mode("overwrite").save()


def relieve() -> None:
    """Give freed memory back to the system: a Python worker that waits for its next task holds none of the last one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def relieved(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """The same function of a task's batches, with `relieve` at the end."""

    def inner(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            relieve()

    return inner


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---- numpy over Arrow ------------------------------------------------------------------------


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and the n + 1 offsets of its values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of values whose bytes come to about `most`; a longer value stands alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (invertible), so that all bits of a polynomial hash count."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Poly:
    """Polynomial prefix hashes modulo 2**64 over bytes mapped to random odd words.

    hash(a, n) is independent of where the n bytes stand. Powers and their inverses grow on demand.
    """

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.of = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(2**40, 2**62)) * 8 + 5) % 2**64
        self.pw = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.pw) < n:
            m = max(n, 2 * len(self.pw))
            for name, b in (("pw", self.base), ("inv", pow(self.base, -1, 2**64))):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self.grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.of[buf] * self.pw[: len(buf)], dtype=np.uint64, out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[at]) * self.inv[at]

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """The hashes of all n-byte windows."""
        return (prefix[n:] - prefix[:-n]) * self.inv[: len(prefix) - n]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; a document's end ends a word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(buf)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return at, end, np.searchsorted(offsets, at, "right") - 1
