"""Helpers shared by the training-data operators: shared-folder tables and skew-safe running sums."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach.

    The cluster names the parent in spark.checkpoint.dir. A local session without it gets a temporary folder; on a
    cluster it has to be set.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        parent = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{parent.rstrip('/')}/corpusops-{uuid.uuid4().hex}"


#: Folder of each table that `stored` wrote and that is still referred to.
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, so a lost
    executor costs nothing before it and nothing is computed twice. What reads it must not outlive the
    folder, which `discard` or the owner of spark.checkpoint.dir removes."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of stored tables that nothing still to be computed reads."""
    for df in tables:
        if path := _folders.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made of it that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_print(docs: DataFrame) -> Column:
    """128 bits of all columns of a row, never null: rows of equal prints are equal."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    parts = [docs["doc_id"].cast("string"), docs["text"].cast("string"), F.to_json(F.struct(*others)) if others else None]
    return F.unhex(F.md5(F.concat(*[F.concat(F.coalesce(F.octet_length(p), F.lit(-1)).cast("string"), F.lit(" "), F.coalesce(p, F.lit(""))) for p in parts if p is not None])))


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, by: list[str], bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name in sums the sum of its column over the rows before the current one (null
    counts as 0), within `by`, ordered by `bucket` (an integer column that agrees with the order) and
    then by `order`.

    No task gets a whole group: the rows of one bucket are summed first, the bucket sums are
    accumulated, and a row's own sum is taken inside its bucket. Buckets therefore have to hold few
    rows each; by and bucket must not be null.
    """
    keys = [*by, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_sum_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.select("*", *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside), F.lit(0)).alias(f"_own_{n}") for n, c in sums.items()])
    out = own.join(starts, keys)
    return out.select(*[out[c] for c in df.columns], *[(F.col(f"_before_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums])


def range_keys(ids: pa.Array, prints: pa.Array) -> np.ndarray:
    """Keys of 17 bytes whose order as bytes is that of (null id first, id, print)."""
    out = np.empty((len(ids), 17), np.uint8)
    out[:, 0] = ids.is_valid().to_numpy(zero_copy_only=False)
    for column, values in ((1, ids.fill_null(0)), (9, prints)):
        out[:, column : column + 8] = (values.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def range_starts(rows: DataFrame, ranges: int) -> np.ndarray:
    """The first key of each of at most `ranges` ranges of equal size, by the columns id and print (longs, print never null);
    one row a range comes to the driver. Rows of one id are parted by print."""
    key = F.struct(F.col("id").isNotNull().alias("some"), "id", "print")
    firsts = rows.select("id", "print").repartitionByRange(ranges, "id", "print").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("k")).select("k.*").collect()
    return np.unique(range_keys(pa.array([r.id for r in firsts], pa.int64()), pa.array([r.print for r in firsts], pa.int64())))


def range_of(starts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The range that each key is in."""
    return np.maximum(np.searchsorted(starts, keys, side="right") - 1, 0)
