"""Context for an answer: fields by question, blocks of results, one text per question within a limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusops.functions.text import has_any_token
from corpusops.operators.ranking import keep_first


def relevant_fields(intent: Column, text: Column, base: Mapping[str, Sequence[str]], cues: Mapping[str, Sequence[str]]) -> Column:
    """The fields of the intent, and those of which the text has a cue."""
    strings = lambda words: F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    fields = F.coalesce(*[F.when(intent == i, strings(f)) for i, f in base.items()], strings([]))
    for field, words in cues.items():
        fields = F.array_union(fields, F.when(has_any_token(text, words), strings([field])).otherwise(strings([])))
    return fields


def render_result(source: Column, fields: Sequence[tuple[str, Column, int]], fallback: Column) -> Column:
    """A block: its source, then the fields that are there, cut to their limits; the content if none is."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.substring(v, 1, n))) for label, v, n in fields]
    any_ = F.concat_ws("\n", *lines)
    return F.concat(F.lit("[Source: "), source, F.lit("]\n"), F.when(any_ == "", fallback).otherwise(any_))


def render_by_intent(intent: Column, source: Column, blocks: Mapping[str, Sequence[tuple[str, Column, int]]], fallback: Column) -> Column:
    """render_result with the fields of the intent; the content where the intent has none."""
    plain = F.concat(F.lit("[Source: "), source, F.lit("]\n"), fallback)
    return F.coalesce(*[F.when(intent == name, render_result(source, fields, fallback)) for name, fields in blocks.items()], plain)


def picked(value: Column, metadata: Column, key: str) -> Column:
    """The value or, where it is null or empty, the metadata's of that key; null without either."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(some(value), some(F.try_element_at(metadata, F.lit(key))))


def line(label: str, value: Column, most: int | None = None) -> Column:
    """"Label: value", cut; null without a value."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.when(text.isNotNull(), F.concat(F.lit(f"{label}: "), F.substring(text, 1, most) if most else text))


def if_asked(fields: Column, names: Sequence[str], shown: Column) -> Column:
    """The line, if one of the names is among the fields that a question asks for."""
    return F.when(F.arrays_overlap(fields, F.array(*map(F.lit, names))), shown)


def counted(values: Column, most: int) -> Column:
    """The first values, and how many more there are."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def below(title: str, values: Column, most: int, cut: int, mark: str = "  - ") -> Column:
    """A title and the first values below it, a line each; null without values."""
    shown = F.transform(F.slice(F.filter(values, lambda v: v.isNotNull()), 1, most), lambda v: F.concat(F.lit(mark), F.substring(v, 1, cut)))
    return F.when(F.size(shown) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(shown, "\n")))


@dataclass(frozen=True)
class Block:
    """How results of a kind are shown: by their lines; without a name by their content, of `bare` characters; if `ready` is given, by so many
    characters of their content also where there is a name, as it is text that was made to be shown."""

    name: Column
    lines: Sequence[Column]
    bare: int = 400
    ready: int = 0


def render_block(source: Column, content: Column, block: Block) -> Column:
    """The source's line and the block; an empty text where there is nothing to show."""
    said, named = F.nullif(content, F.lit("")), F.coalesce(block.name, F.lit("")) != ""
    body = F.when(named, F.concat_ws("\n", *block.lines)).otherwise(F.substring(said, 1, block.bare))
    if block.ready:
        body = F.when(named & said.isNotNull(), F.substring(said, 1, block.ready)).otherwise(body)
    return F.coalesce(F.concat(F.lit("[Source: "), source, F.lit("]\n"), body), F.lit(""))


def render_kinds(kind: Column, source: Column, content: Column, blocks: Mapping[str, Block], otherwise: Block) -> Column:
    """render_block with the block of each kind; kinds without one get `otherwise`."""
    arms = [F.when(kind == name, render_block(source, content, block)) for name, block in blocks.items()]
    return F.coalesce(*arms, render_block(source, content, otherwise))


def listed(values: Column, most: int = 5) -> Column:
    """The first values of a list as text."""
    return F.array_join(F.slice(values, 1, most), ", ")


def build_context(results: DataFrame, most: int = 4000, marker: str = "[...additional results omitted]") -> DataFrame:
    """(query_id, context): blocks in rank order without repeated names, joined by blank lines, cut. results:
    (query_id, rank, name, block), at most some tens of rows a question."""
    first = keep_first(results, [F.col("query_id"), F.lower("name")], [F.asc("rank")])
    joined = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    return joined.withColumn("context", F.when(F.length("context") > most, F.concat(F.substring("context", 1, most), F.lit(marker))).otherwise(F.col("context")))


def filter_blocks(context: Column, label: str, value: str, sep: str = "\n\n") -> Column:
    """The blocks whose line "label:" holds the value."""
    return F.array_join(F.filter(F.split(context, sep), lambda b: b.rlike(rf"(?i)\b{label}:[^\n]*{value}")), sep)


def sectioned_context(results: DataFrame, by: str, section: str, number: str, rank: str, content: str) -> DataFrame:
    """"=== SECTION INFORMATION ===" and its contents, for each section in order."""
    parts = results.groupBy(by, section, number).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, content))), lambda x: x[content]), "\n").alias("_body"))
    text = F.concat(F.lit("=== "), F.upper(section), F.lit(" INFORMATION ===\n"), "_body")
    return parts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text.alias("_text")))), lambda x: x["_text"]), "\n\n").alias("context"))
