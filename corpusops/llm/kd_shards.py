"""K-d tree partitioning of documents into shards of near equal bytes (native DataFrame operations only).

The tree starts with all documents and as many shards as wanted. A node of k shards is split into
floor(k / 2) and ceil(k / 2) shards along its widest metadata dimension (the range of the dimension in the
node over its range in the table) at the weighted quantile of its bytes that matches. All nodes of a
level are split together. The quantile is exact: histograms of at most BINS bins a node narrow it down
level by level, first on the dimension, then, inside one value, on the CRC-32 of the text, and last on
doc_id and the row. So equal texts of one node that are equal in its dimension are cut apart only where they are
heavier than `snap` of a shard; copies of different source or language may come to different shards.
The driver sees one row per node and pass, which number of shards bounds; documents are never collected.

Defined results: a null text counts as no bytes (size 8). Very long texts are one document of their shard, which
then is as heavy as it must be. Null dimensions sort first. Repeated rows are
separate documents. With fewer documents than shards some shards stay empty. An empty table gives no rows.
Only the columns doc_id, text, lang and source are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusops.llm.common import running, stored, table

BINS = 4096
DIMENSIONS = ("size", "source_code", "lang_code")
#: What orders documents inside one value of a dimension.
TIES = ("text_crc32", "id", "row")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the integer dimensions; a name's dimension is its CRC-32."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")), F.lit(-1))
    return docs.select(
        "doc_id",
        (F.octet_length("text").cast("long")).alias("_bytes"),
        F.crc32(text).alias("text_crc32"),
        code("source").alias("source_code"),
        code("lang").alias("lang_code"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("size", F.coalesce("_bytes", F.lit(0)) + 8).drop("_bytes")


def small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of the driver's own rows, at most one per node."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def extents(rows: DataFrame) -> dict[int, dict]:
    out = rows.groupBy("node").agg(F.sum("size").alias("weight"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
    return {r["node"]: r.asDict() for r in out.collect()}


def at(dim: Column) -> Column:
    return F.element_at(F.array(*[F.col(d) for d in DIMENSIONS]), dim + 1)


def find_cuts(rows: DataFrame, nodes: dict[int, dict], snap: float) -> dict[int, dict]:
    """For each node of nodes (dim, lo, hi, goal) the cut: the documents up to and with the values in
    `fixed` go left (`inclusive`), or those before them. Each pass narrows every open node's range."""
    spark, keys = rows.sparkSession, ["_key0", *TIES]
    keyed = [F.col("_key0"), *[F.col(t) for t in TIES]]
    state = {n: {"fixed": [], "lo": x["lo"], "hi": x["hi"], "below": 0, **x} for n, x in nodes.items()}
    done: dict[int, dict] = {}
    while state:
        plan = [{"node": n, "dim": s["dim"], "depth": len(s["fixed"]), "lo": s["lo"], "hi": s["hi"], "goal": s["goal"] - s["below"], **{f"f{i}": v for i, v in enumerate(s["fixed"])}} for n, s in state.items()]
        asked = small(spark, plan, "node long, dim int, depth int, lo long, hi long, goal double, f0 long, f1 long, f2 long").withColumnRenamed("node", "_node")
        # at most one row per node: as many as shards
        joined = rows.join(F.broadcast(asked), F.col("node") == F.col("_node")).withColumn("_key0", at(F.col("dim")))
        for i in range(3):
            joined = joined.where((F.col("depth") <= i) | (F.col(f"f{i}") == keyed[i]))
        value = F.element_at(F.array(*keyed), F.col("depth") + 1)
        step = F.floor((F.col("hi") - F.col("lo")) / BINS) + 1
        binned = joined.withColumn("_v", value).where("_v BETWEEN lo AND hi").withColumn("_bin", F.floor((F.col("_v") - F.col("lo")) / step))
        counts = binned.groupBy("node", "_bin").agg(F.first("goal").alias("goal"), F.sum("size").alias("weight"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), *[f(k).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))])
        upto = Window.partitionBy("node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("before", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        cross = summed.where("before < goal AND before + weight >= goal").collect()
        assert {r["node"] for r in cross} == set(state)
        for r in cross:
            s = state[r["node"]]
            s |= {"below": s["below"] + r["before"], "lo": r["lo"], "hi": r["hi"]}
            if r["lo"] < r["hi"]:
                continue
            s["fixed"].append(r["lo"])
            depth = len(s["fixed"])
            over = s["below"] + r["weight"] - s["goal"]
            if depth == len(keys) or (depth > 1 and r["weight"] <= snap):
                done[r["node"]] = {"dim": s["dim"], "fixed": s["fixed"], "inclusive": over <= s["goal"] - s["below"]}
                del state[r["node"]]
            else:
                s |= {"lo": r[f"lo_{depth}"], "hi": r[f"hi_{depth}"]}
    return done


def kd_shards(docs: DataFrame, shards: int = 24, snap: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, for every row of docs.

    snap: the largest share of a shard's bytes that a group of equal texts may move a cut by."""
    spark = docs.sparkSession
    rows = stored(metadata(docs).withColumn("node", F.lit(0).cast("long")))
    whole = extents(rows)
    spans = {d: max(1, whole[0][f"hi_{d}"] - whole[0][f"lo_{d}"]) for d in DIMENSIONS} if whole else {}
    allowed = snap * whole[0]["weight"] / shards if whole else 0
    open_ = {0: shards}  # a node's number is its first shard
    extent = whole
    while any(k > 1 for k in open_.values()) and extent:
        wanted = {}
        for node, k in open_.items():
            if k > 1 and node in extent:
                e = extent[node]
                dim = max(range(len(DIMENSIONS)), key=lambda i: ((e[f"hi_{DIMENSIONS[i]}"] - e[f"lo_{DIMENSIONS[i]}"]) / spans[DIMENSIONS[i]], -i))
                d = DIMENSIONS[dim]
                wanted[node] = {"dim": dim, "lo": e[f"lo_{d}"], "hi": e[f"hi_{d}"], "goal": e["weight"] * (k // 2) / k}
        cuts = find_cuts(rows, wanted, allowed)
        plan = [{"node": n, "dim": c["dim"], "depth": len(c["fixed"]), "inclusive": c["inclusive"], "right": n + open_[n] // 2, **{f"f{i}": v for i, v in enumerate(c["fixed"])}} for n, c in cuts.items()]
        asked = small(spark, plan, "node long, dim int, depth int, inclusive boolean, right long, f0 long, f1 long, f2 long, f3 long").withColumnRenamed("node", "_node")
        joined = rows.join(F.broadcast(asked), F.col("node") == F.col("_node"), "left")
        keyed = [at(F.col("dim")), *[F.col(t) for t in TIES]]
        left = F.col("inclusive")
        for i in reversed(range(4)):  # lexicographic: the first key that differs decides
            left = F.when(F.col("depth") <= i, F.col("inclusive")).when(keyed[i] < F.col(f"f{i}"), True).when(keyed[i] > F.col(f"f{i}"), False).otherwise(left)
        rows = stored(joined.withColumn("node", F.when(F.col("_node").isNull() | left, F.col("node")).otherwise(F.col("right"))).select(*rows.columns))
        open_ = {n: k for node, width in open_.items() for n, k in ([(node, width)] if width == 1 else [(node, width // 2), (node + width // 2, width - width // 2)])}
        extent = extents(rows)
    count = rows.count()
    parts = max(1, count // 1024)
    slotted = running(rows.withColumn("_bucket", F.pmod(F.xxhash64("id", "row"), F.lit(parts))), ["node"], "_bucket", [F.col("id"), F.col("row")], {"slot": F.lit(1)})
    return slotted.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
