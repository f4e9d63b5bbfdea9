"""What the operators of this subpackage share: tables, scratch storage and word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte, so that UTF-8 stays valid.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: The white space between words: blank, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """The same rows under column names ``c0``, ``c1`` and so on, which clash with nothing."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. A name is taken as it is spelt, or else in any case; other columns may clash with it."""
    held = df.columns
    lowered = [c.lower() for c in held]
    at = [held.index(n) if n in held else lowered.index(n.lower()) for n in names]
    return plain(df).select(*(F.col(f"c{k}").alias(n) for k, n in zip(at, names)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one of our own in local mode, as in tests; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="modweave-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def small_batches(df: DataFrame) -> None:
    """Lets 4 MB of a table go to Python at once where the session has Spark's default of 64 MB; texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, "4m")


@lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def releasing(run: Callable) -> Callable:
    """A function over batches that gives its worker's unused memory back at a task's end; idle workers are kept."""

    @wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return held


class Scratch:
    """Parquet tables in the shared folder; they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class KeyBits:
    """One bit for the hash of each key of a table; of other keys few, or in a full table all, have theirs set as well.

    The bits are 16 a key and no more than ``most``, so what is sent is bounded; a join decides about the keys it lets through.
    """

    def __init__(self, keys: DataFrame, name: str, most: int = 1 << 26):
        count = keys.count()
        self.size = 1 << 10
        while self.size < min(most, 16 * count):
            self.size *= 2
        words = keys.select(self.place(name).alias("at")).select(F.expr("at div 64").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(self.size // 64, np.int64)
        bits[found["w"].to_numpy()] = found["b"].to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def place(self, name: str):
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(self.size))

    def select(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows whose key may be one of the table's."""
        sent = self.sent

        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for batch in batches:
                at = numbers(batch, "at").to_numpy()
                hit = bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
                yield batch.drop_columns(["at"]).filter(pa.array(hit == 1))

        return rows.withColumn("at", self.place(name)).mapInArrow(run, rows.schema)


def rows_as_bytes(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 ``bytes`` (null: None), without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def numbers(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit factors; a sum of word hashes times these tells word sequences apart."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def ngram_hashes(words: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """A hash of every run of ``n`` words (none where there are fewer)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k, factor in enumerate(odd_multipliers(n, seed)):
        out += words[k : k + count] * factor
    return mix64(out)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches that are sorted by them; a run ends with its key."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [numbers(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
