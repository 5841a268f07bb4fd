"""Entities to text documents: templates, facets, chunks of children, overviews and maps as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.window import Window

from corpusops.functions.text import humanize_key
from corpusops.sources.files import row_index, stored


def render_template(fields: Sequence[tuple[str, Column, str | None]], sep: str = "\n") -> Column:
    """Lines "Label: value"; a null or empty value is its default, or without one leaves the line out."""
    lines = []
    for label, value, default in fields:
        text = F.nullif(value.cast("string"), F.lit(""))
        text = F.coalesce(text, F.lit(default)) if default is not None else text
        lines.append(F.when(text.isNotNull(), F.concat(F.lit(f"{label}: "), text)))
    return F.concat_ws(sep, *lines)


def format_hours(hours: Column) -> Column:
    """"day: time" joined by "; " without null and Closed days; words for none left and for none at all."""
    entries = F.filter(F.map_entries(hours), lambda e: e["value"].isNotNull() & (e["value"] != "Closed"))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return F.when(F.coalesce(F.size(F.map_keys(hours)), F.lit(0)) <= 0, "Hours not available").when(F.size(entries) == 0, "Hours vary").otherwise(text)


def yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "Yes").otherwise("No")


def first_nonempty(arrays: Sequence[Column], sep: str = "; ") -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, F.array_join(a, sep)) for a in arrays])


def join_pairs(items: Column, keys: Sequence[str], value: str, sep: str = "; ") -> Column:
    """"key: value" of each struct, the key being the first of the alternatives that is there."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.coalesce(*[x[k].cast("string") for k in keys]), F.lit(": "), x[value].cast("string"))), sep)


def split_facets(df: DataFrame, keys: Sequence[str], facets: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One document per facet (type, condition, text) whose condition holds."""
    made = F.array(*[F.struct(F.lit(t).alias("type"), F.when(cond, text).alias("text")) for t, cond, text in facets])
    return df.select(*keys, F.inline(F.filter(made, lambda x: x["text"].isNotNull())))


def chunk_children(df: DataFrame, parent: str, order: str, text: Column, size: int = 5, sep: str = "; ", stretch: int = 4096) -> DataFrame:
    """(parent, chunk, n, text): children in groups of `size`, numbered from 1 in a numeric order. They are
    numbered inside stretches of the order first, whose sizes are then added up, so that no task gets all
    children of a parent."""
    rows = df.select(parent, order, text.alias("_text"), F.floor(F.col(order) / stretch).alias("_stretch"))
    sizes = rows.groupBy(parent, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(parent).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(parent).alias("_parent"), F.col("_stretch").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(parent, "_stretch").orderBy(order)))
    numbered = own.join(starts, F.col(parent).eqNullSafe(F.col("_parent")) & (F.col("_stretch") == F.col("_of"))).withColumn("_rn", F.col("_start") + F.col("_rn"))
    grouped = numbered.groupBy(parent, (F.floor((F.col("_rn") - 1) / size) + 1).alias("chunk"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_text"))), lambda x: x["_text"]), sep).alias("text"))


def subset_document(df: DataFrame, parent: str, column: str, terms: Sequence[str], order: str) -> DataFrame:
    """One document per parent of the children that hold any of the terms; none without such children."""
    low = F.lower(column)
    fit = df.where(F.greatest(*[low.contains(t) for t in terms], F.lit(False)))
    return fit.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), "; ").alias("text"))


def parent_overview(df: DataFrame, parent: str, name: str) -> DataFrame:
    return df.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("names"))


def flatten_tree(tree: Column, schema, skip: Sequence[str] = (), category: str = "") -> list[Column]:
    """(category, item, value) structs of a nested struct, the category being the nearest container's name;
    built from the schema when the job is planned."""
    from pyspark.sql import types as T

    out = []
    for field in schema.fields:
        if field.name in skip:
            continue
        if isinstance(field.dataType, T.StructType):
            out += flatten_tree(tree[field.name], field.dataType, skip, field.name)
        else:
            out.append(F.struct(F.lit(category).alias("category"), F.lit(field.name).alias("item"), tree[field.name].cast("string").alias("value")))
    return out


def flatten_json(df: DataFrame, keys: Sequence[str], json: str, skip: Sequence[str] = ()) -> DataFrame:
    """(keys, category, item, value) of JSON of any depth: a row for each field of an object that is no container, the
    category being the nearest container's key. Items of a list have the list's category; items that are no
    container, and fields named in skip with all below them, give nothing.

    Texts are parsed to VARIANT once. A round opens all containers by one level; those inside them are stored for the next round, and
    there are as many rounds as levels. Malformed and null texts give nothing."""
    rows = df.select(*keys, F.lit("").alias("_category"), F.try_parse_json(json).alias("_tree")).where("_tree IS NOT NULL")
    open_ = rows.where(_container(F.col("_tree")))
    done = None
    while True:
        inside = open_.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_tree").outer()))
        inside = inside.where(F.col("key").isNull() | ~F.col("key").isin(list(skip)) if skip else F.lit(True))
        level = stored(inside.select(*keys, F.coalesce("key", "_category").alias("_below"), "_category", "key", "value", _container(F.col("value")).alias("_open")), "tree")
        found = level.where("key IS NOT NULL AND NOT _open").select(*keys, F.col("_category").alias("category"), F.col("key").alias("item"), F.col("value").cast("string").alias("value"))
        done = found if done is None else done.unionByName(found)
        deeper = level.where("_open")
        if deeper.isEmpty():
            return done
        open_ = deeper.select(*keys, F.col("_below").alias("_category"), F.col("value").alias("_tree"))


def _container(tree: Column) -> Column:
    return F.coalesce(F.schema_of_variant(tree).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def _reason(name: str, invalid: Sequence[str]) -> Column:
    """Why a row of that name is dropped; null if it stays."""
    marked = F.greatest(*[F.col(name).contains(x) for x in invalid], F.lit(False))
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "no name").when(marked, "invalid name")


def searchable_text(df: DataFrame, name: str, fields: Sequence[str], invalid: Sequence[str] = ("Sign-On", "SSO")) -> DataFrame:
    """Adds text; rows without a name, or with an invalid mark in it, go."""
    return df.where(_reason(name, invalid).isNull()).withColumn("searchable_text", F.concat_ws(" ", *fields))


def searchable_text_counted(df: DataFrame, name: str, fields: Sequence[str], invalid: Sequence[str] = ("Sign-On", "SSO")) -> tuple[DataFrame, Observation]:
    """searchable_text, and an observation of how many rows it has seen, kept and dropped for each reason (`seen`, `no_name`, `invalid_name`).
    The counts are taken by the action that writes or collects the rows, without a pass of their own."""
    counted, reason = Observation(), _reason(name, invalid)
    seen = df.observe(counted, F.count(F.lit(1)).alias("seen"), *[F.count_if(reason == r).alias(r.replace(" ", "_")) for r in ("no name", "invalid name")])
    return searchable_text(seen, name, fields, invalid), counted


def text_or_fallback(columns: Sequence[str], template: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], template)


def map_sections(sections: Column, labels: Sequence[tuple[str, str]] | None = None) -> Column:
    """A map as text: the key in title case as heading, then its items. Of a map of lists these are bullets; of a map of structs, for
    which labels (field, label) are given, lines "Label: value" without the fields that are null or empty. Entries without
    items keep their heading."""
    bullets = lambda v: F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n")
    lines = lambda v: render_template([(label, v[field], None) for field, label in labels])
    entries = F.array_sort(F.map_entries(sections))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("\n", humanize_key(e["key"]), F.nullif((lines if labels else bullets)(e["value"]), F.lit("")))), "\n")


def scalarize_metadata(df: DataFrame, drop: Sequence[str]) -> Column:
    """A map of the scalar columns as strings; null is "None"."""
    from pyspark.sql import types as T

    names = [f.name for f in df.schema if f.name not in drop and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("None")))])


def ensure_unique_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """A repeated id gets its row's place in the whole table, from 0 in the order, appended."""
    again = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return row_index(df, [F.col(order)], "_at").withColumn("unique_id", F.when(again > 1, F.concat_ws("_", F.col(id_col), F.col("_at").cast("string"))).otherwise(F.col(id_col))).drop("_at")


def dropped_names(df: DataFrame, name: str, invalid: Sequence[str] = ("Sign-On", "SSO")) -> DataFrame:
    """(reason, n): how many rows searchable_text drops, and why."""
    return df.select(_reason(name, invalid).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
