"""What the operators share: table reads, shared folders, cutting lineage, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an operator works on at a time in a Python worker: so many rows and bytes, or one longer row.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def quoted(name: str) -> str:
    """A top-level column's name as Spark reads it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Spark sends SLICE_BYTES at once to Python, not 64 MB: buffers of both sides hold several times that.

    The session's bound is only ever lowered, to the same value for all operators.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def sliced(batches, *columns: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The batches in slices of at most `rows` rows and, but for single longer rows, `size` bytes of the text or binary columns named."""
    for b in batches:
        if b.num_rows <= 1:
            yield b
            continue
        total = np.zeros(b.num_rows, np.int64)
        for c in columns:
            total += pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(total), 0
        while at < b.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            n = max(1, min(rows, most - at))
            yield b.slice(at, n)
            at += n


def map_rows(df: DataFrame, run) -> DataFrame:
    """df.mapInArrow of a function that keeps df's columns, whatever their names are."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df in a total order with each row's place from 0, without one task for all rows.

    Rows are range-partitioned and sorted; the driver gets one count a partition.
    The places are those of the order, however Spark cuts the ranges; rows that are
    equal in it take places in turn.
    """
    place = F.monotonically_increasing_id()  # partition << 33 | place in it
    spread = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", place))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for p, n in sorted(spread.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, before))
        before += n
    start = F.create_map(*[F.lit(v) for pair in offsets for v in pair])[part] if offsets else F.lit(0)
    return spread.withColumn(name, (start + inside).cast("long")).drop("_m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without it (tests): then a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dir()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lumenframe-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder's name in the shared one. What is written there goes when the application ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    # Only what exists can be marked, and Spark's writers want their own folder new.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder; later plans start there and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a Bitmap: 2 MB, or where more are asked for 32 MB at most.
FILTER_BITS, MOST_BITS = 1 << 24, 1 << 28


def known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (longs) a Bitmap's bits hold."""
    at = hashes & (8 * len(bits) - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


class Bitmap:
    """Which hashes, modulo the number of bits, occur among the keys (one column of any number of rows).

    It has at least `size` bits up to MOST_BITS, whatever the number of keys. Keys
    that are hashes already, as longs, stand for themselves.
    """

    def __init__(self, keys: DataFrame, hashed: bool = False, size: int = FILTER_BITS) -> None:
        n = FILTER_BITS
        while n < min(size, MOST_BITS):
            n *= 2
        h = F.pmod(F.col(keys.columns[0]) if hashed else F.xxhash64(keys.columns[0]), F.lit(n)) + 1  # buckets count from 1
        parts = keys.select(F.bitmap_bucket_number(h).alias("n"), F.bitmap_bit_position(h).alias("p")).groupBy("n").agg(F.bitmap_construct_agg("p").alias("b")).collect()
        bits = np.zeros(n // 8, np.uint8)
        for k, b in parts:
            bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(b, np.uint8)[: n // 8 - (k - 1) * 4096]
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)  # bit p of bucket n is hash (n - 1) * 32768 + p

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """df without most rows whose column is not among the keys, before df is shuffled. More keys than bits keep all rows."""
        shared, names = self.shared, df.columns

        def run(batches):
            bits = shared.value
            for b in batches:
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(known(bits, b.column(b.num_columns - 1).to_numpy()))).columns[:-1], names)

        tagged = df.withColumn("_h", F.xxhash64(column))
        return tagged.mapInArrow(run, df.schema)


def likely(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df without most rows whose column is not among the keys; a join decides about the rest."""
    return Bitmap(keys).keep(df, column)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (u, v) long pairs by alternating star contraction.

    Returns (node, root): every node that has an edge, with the smallest node of
    its component. Each round is two hash aggregations and two joins, so neither
    edges nor components ever meet in one task or on the driver; only a count
    and a checksum do. Self links and repeated links are ignored, an empty table
    gives an empty table.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e, before = cut(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        e = cut(small)
        row = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    else:
        raise RuntimeError(f"no fixed point of the components after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
