"""Readers and writers of the formats that catalogues and timetables come in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from corpusops.functions.text import slug

COURSE = "subject string, number string, course_code string, title string, credits string, level string, description string, prerequisites string, school string, department string"
PERSON = "name string, title string, office string, phone string, email string, research_interests array<string>, biography string, profile_url string"
DEPARTMENT = f"name string, building string, address string, phone string, email string, website string, faculty array<struct<{', '.join(f'{a}: {b}' for a, b in (x.rsplit(' ', 1) for x in PERSON.split(', ')))}>>"
GTFS = {
    "routes": "route_id string, route_short_name string, route_long_name string, route_desc string, route_color string, route_url string",
    "calendar": "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string",
    "trips": "route_id string, service_id string",
    "stops": "stop_id string, stop_name string, stop_lat string, stop_lon string",
}


#: Bytes of files a core up to which a table is dealt anew.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores dealt evenly to the cores, as one file may be one split. A table of many files, or of large
    ones, which have splits enough, stays as it is."""
    cores, names = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    if len(names) >= cores:
        return df
    size = sum(files.getFileStatus(where).getLen() for where, files in (file_system(df.sparkSession, n) for n in names))
    return df.repartition(cores) if size <= cores * SMALL else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach: under spark.checkpoint.dir or, in a local session without it, a
    temporary one."""
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        parent = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{parent.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = file_system(spark, path)
    return files.exists(where)


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number and bytes of the files of a table, and when its folder (or only file) last changed."""
    where, files = file_system(spark, path)
    whole = files.getContentSummary(where)
    return whole.getFileCount(), whole.getLength(), files.getFileStatus(where).getModificationTime()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df written to a shared folder and read again, so that what depends on how rows are dealt stays as it is."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Adds each row's place in the order, from 0. Rows are sorted by ranges: a task numbers those of its own
    range, and only the ranges' sizes are added up in one place."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "indexed")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row per range
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_start", "_place")


def read_wrapped_json(spark: SparkSession, path: str, array_field: str, schema: str = COURSE) -> DataFrame:
    """The records of {..., array_field: [...]} files."""
    wrapped = T.StructType().add(array_field, T.ArrayType(T.StructType.fromDDL(schema)))
    return spark.read.option("multiLine", True).schema(wrapped).json(path).select(F.inline(array_field))


def read_keyed_groups(spark: SparkSession, path: str, schema: str = DEPARTMENT) -> DataFrame:
    """Files of {key: {...}} as (key, value struct)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StructType.fromDDL(schema)))).alias("key", "value"))


def flatten_keyed_groups(groups: DataFrame, items: str, name: str = "name") -> DataFrame:
    """(key, value struct with an array of structs) to one row per item, with the group's key and name; a
    missing name is the key."""
    group = F.coalesce(F.col(f"value.{name}"), F.col("key"))
    rows = groups.select("key", group.alias("group_name"), F.explode(f"value.{items}").alias("item"))
    return rows.select("key", "group_name", "item.*") if "name" not in rows.schema["item"].dataType.names or name != "group_name" else rows.select("key", "group_name", "item")


def latest_snapshot(df: DataFrame, snapshot: Column) -> DataFrame:
    """Rows of the greatest snapshot name: names end in a timestamp."""
    named = df.withColumn("_snapshot", snapshot)
    last = named.agg(F.max("_snapshot").alias("_last"))
    return named.join(F.broadcast(last), F.col("_snapshot") == F.col("_last"), "left_semi").drop("_snapshot")  # one row


def latest_path(spark: SparkSession, path: str, order: Callable[[Column], Column] | None = None) -> str | None:
    """The file with the greatest name below path (folder or glob), or the greatest `order` of its path; None without files. The listing
    is a table of paths: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    by = order or (lambda p: F.element_at(F.split(p, "/"), -1))
    return files.agg(F.max_by("path", F.struct(by(F.col("path")), "path"))).first()[0]


def latest_file(spark: SparkSession, path: str, schema: str, order: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of that JSON file, with its name; no other file is read."""
    last = latest_path(spark, path, order)
    rows = spark.read.schema(schema).json(last) if last else spark.createDataFrame([], schema)
    return rows.withColumn("file_name", F.lit(last.rsplit("/", 1)[1] if last else None))


def read_gtfs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a feed, typed: colours with #, days as booleans, places as numbers."""
    read = lambda n: spark.read.option("header", True).option("quote", '"').option("ignoreLeadingWhiteSpace", True).schema(GTFS[n]).csv(f"{path}/{n}.txt", enforceSchema=False)
    days = GTFS["calendar"].replace(" string", "").split(", ")[1:8]
    return {
        "routes": read("routes").withColumn("route_color", F.when(F.coalesce("route_color", F.lit("")) != "", F.concat(F.lit("#"), "route_color"))),
        "calendar": read("calendar").withColumns({d: F.col(d) == "1" for d in days}),
        "trips": read("trips"),
        "stops": read("stops").withColumns({c: F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon")}),
    }


def write_partitioned(df: DataFrame, by: Column, path: str, fmt: str = "parquet") -> None:
    """One folder per group, named by its slug."""
    df.withColumn("group_slug", slug(by)).write.mode("overwrite").partitionBy("group_slug").format(fmt).save(path)


def group_manifest(df: DataFrame, key: str) -> DataFrame:
    """Groups by name with their counts, and the totals on each row."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return groups.select(key, "n", F.count(F.lit(1)).over(every).alias("n_groups"), F.sum("n").over(every).alias("n_rows"))  # one row per group


class Corpus:
    """A table in versions: version n lies in the folder n of path and counts once the file n of path/_commits is there, which is
    created last and never replaced. Readers take the newest version that counts, so a run that fails midway, or is still on
    its way, changes nothing for them; of two runs that write the same version one fails at the commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop, self._fs = spark._jvm.org.apache.hadoop.fs.Path, file_system(spark, self.path)[1]

    def versions(self) -> list[int]:
        commits = self._hadoop(f"{self.path}/_commits")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(commits)) if self._fs.exists(commits) else []

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or one that is still there."""
        versions = self.versions()
        if not versions or version is not None and version not in versions:
            raise FileNotFoundError(f"{self.path} has no such version")
        return self.spark.read.parquet(f"{self.path}/{versions[-1] if version is None else version}")

    def rebuild(self, df: DataFrame, replace: bool = True, keep: int = 2) -> None:
        """Makes df the newest version, unless there is one and it must not be replaced. The `keep` newest versions stay."""
        versions = self.versions()
        if versions and not replace:
            return
        new = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").parquet(f"{self.path}/{new}")  # what a failed run left there counts for nothing
        self._fs.create(self._hadoop(f"{self.path}/_commits/{new}"), False).close()
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            self._fs.delete(self._hadoop(f"{self.path}/_commits/{old}"), False)
            self._fs.delete(self._hadoop(f"{self.path}/{old}"), True)

    def upsert(self, df: DataFrame, key: str, content: Sequence[str], make: Callable[[DataFrame], DataFrame] = lambda rows: rows, keep: int = 2) -> None:
        """Adds the rows of df and replaces those of the same key. Rows whose content, told by a hash, is as it was keep what `make` once
        made of them; it is applied to new and changed rows only. Keys are unique in df."""
        digest = F.sha2(F.to_json(F.struct(*content)), 256)
        rows = df.withColumn("content_hash", digest)
        if not self.versions():
            return self.rebuild(make(rows), keep=keep)
        old = self.read()
        known = old.select(key, "content_hash")
        changed = rows.join(known, [key, "content_hash"], "left_anti")
        stay = old.join(changed.select(key), key, "left_anti")
        return self.rebuild(stay.unionByName(make(changed)), keep=keep)


def rebuild_corpus(df: DataFrame, path: str, replace: bool = True) -> None:
    """Writes the corpus anew as its newest version, or leaves one that is there."""
    Corpus(df.sparkSession, path).rebuild(df, replace)


def export_newest(df: DataFrame, ts: str, tie: str, n: int, path: str, fmt: str = "csv") -> None:
    """Writes the n newest rows, newest first, as CSV with a header or as JSON lines."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"no such format: {fmt}")
    newest = df.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    write = newest.write.format(fmt)
    (write.option("header", True).option("escape", '"') if fmt == "csv" else write.option("ignoreNullFields", False)).save(path)


def jsonp(df: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per result of callback({"results": [...]}) or callback([...])."""
    body = F.regexp_extract(column, r"(?s)^[^({\[]*\(?\s*(.*?)\s*\)?;?\s*$", 1)
    struct = T.StructType.fromDDL(schema)
    results = F.when(body.startswith("["), F.from_json(body, T.ArrayType(struct))).otherwise(F.from_json(body, T.StructType().add("results", T.ArrayType(struct)))["results"])
    return df.select(*[c for c in df.columns if c != column], F.inline(results))
