"""Relations in catalogues and timetables: codes in text, prerequisite edges, service days, flags and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusops.functions.rules import first_keyword_type

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# What a program's name holds, and its type; the first rule with a match counts.
PROGRAM_TYPES = {
    "doctoral": ("ph.d", "doctor"),
    "masters": ("master", "m.a.", "m.s.", "m.arch"),
    "bachelors": ("bachelor", "b.a.", "b.s.", "b.f.a."),
    "certificate": ("certificate",),
    "minor": ("minor",),
}
# The rules of a program list that writes degrees out.
DEGREE_TYPES = {
    "doctoral": ("doctor of philosophy", "phd"),
    "masters": ("master of science", "master of engineering"),
    "bachelors": ("bachelor",),
    "certificate": ("certificate",),
}


def course_codes(text: Column, pattern: str = r"([A-Z]{2,5})\s+([0-9]{3})") -> Column:
    """Distinct codes in the order of their first place."""
    return F.array_distinct(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda s, n: F.concat_ws(" ", s, n)))


def prerequisite_edges(courses: DataFrame, code: str, text: str) -> DataFrame:
    return courses.select(F.col(code).alias("course_code"), F.explode(course_codes(F.col(text))).alias("prereq_code")).where("course_code != prereq_code")


def program_requirements(courses: DataFrame, program: str, code: str, admission: str, plan: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """Distinct required codes and the first 500 characters of the admission text of each program; with plan (program, place, year, fall,
    spring) and outcomes (program, place, outcome), tables of one catalogue page each, also both as lists in their order."""
    out = courses.groupBy(program).agg(F.array_join(F.array_sort(F.collect_set(code)), "|").alias("required"), F.substring(F.min(admission), 1, 500).alias("admission"))
    for name, table, item in (("plan", plan, F.struct("year", "fall", "spring")), ("outcomes", outcomes, F.col("outcome"))):
        if table is not None:
            lists = table.groupBy(program).agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))).alias("_items"))
            out = out.join(lists.select(program, F.transform("_items", lambda x: x["item"]).alias(name)), program, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{lists.schema['_items'].dataType.elementType['item'].dataType.simpleString()}>")))
    return out


def program_type(name: Column, rules: Mapping[str, Sequence[str]] = PROGRAM_TYPES) -> Column:
    return first_keyword_type(name, rules, "other")


def route_service_days(routes: DataFrame, trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """(route_id, days...): on which days any service of the route runs. Routes without trips, and services
    without calendar, count as not running."""
    served = routes.select("route_id").join(trips.select("route_id", "service_id").distinct(), "route_id", "left").join(calendar, "service_id", "left")
    return served.groupBy("route_id").agg(*[F.coalesce(F.bool_or(d), F.lit(False)).alias(d) for d in DAYS])


def day_label(days: Mapping[str, Column] | None = None) -> Column:
    """The first label that fits. Monday and Friday stand for all weekdays there; Thursday without Friday is
    Monday-Thursday whatever the weekend; only all seven days are Daily."""
    d = days or {x: F.col(x) for x in DAYS}
    week, saturday, sunday = d["monday"] & d["friday"], d["saturday"], d["sunday"]
    every = F.array_join(F.array_compact(F.array(*[F.when(d[x], F.initcap(F.lit(x[:3]))) for x in DAYS])), ", ")
    return (
        F.when(week & saturday & ~sunday, "Monday-Saturday").when(week & ~saturday & ~sunday, "Monday-Friday")
        .when(d["monday"] & d["thursday"] & ~d["friday"], "Monday-Thursday")
        .when(F.least(*d.values()), "Daily").when(every != "", every).otherwise("Special schedule")
    )


def numeric_first(column: Column, otherwise: int = 999) -> list[Column]:
    """Sort keys: numbers by value, everything else at `otherwise`, ties by text."""
    return [F.coalesce(column.try_cast("int"), F.lit(otherwise)), column]


def membership_flags(df: DataFrame, column: str, lists: Mapping[str, Sequence], notes: Mapping[object, str] | None = None) -> DataFrame:
    """A flag for each list that holds the column's value, and the note of the value if there are notes."""
    flagged = df.withColumns({name: F.col(column).isin(list(values)) for name, values in lists.items()})
    if not notes:
        return flagged
    table = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair])
    return flagged.withColumn("note", F.try_element_at(table, F.col(column)))


def catalog_summary(df: DataFrame, group: str, conditions: Mapping[str, Column], names: Mapping[str, str]) -> DataFrame:
    """Counts, and counts under conditions, by group and overall, with display names."""
    shown = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = df.rollup(group).agg(F.grouping(group).alias("_g"), F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.coalesce(F.try_element_at(shown, F.col(group)), F.col(group))).alias("name"), "n", *conditions)


def course_level(number: Column, rule: str = "two") -> Column:
    """two: from 500 graduate. three: from 700 graduate, from 500 advanced_undergraduate."""
    if rule == "two":
        return F.when(number >= 500, "graduate").otherwise("undergraduate")
    return F.when(number >= 700, "graduate").when(number >= 500, "advanced_undergraduate").otherwise("undergraduate")


def course_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, code, title, credits, description, prerequisites, corequisites, core): the text split before
    each course code; blocks that tell credits and have more than fifty characters stay. core is what follows
    "Satisfies:"."""
    code = r"([A-Z]{2,5})\s+([0-9]{3,4})"
    blocks = df.select(key, F.posexplode(F.split(text, r"(?=\b[A-Z]{2,5}\s+[0-9]{3,4}\.\s)")).alias("block_no", "block"))
    fit = blocks.where(F.lower("block").contains("credit") & (F.length("block") > 50) & F.col("block").rlike(f"^{code}"))
    return fit.select(
        key, "block_no",
        F.concat_ws(" ", F.regexp_extract("block", code, 1), F.regexp_extract("block", code, 2)).alias("code"),
        F.regexp_extract("block", r"^[A-Z]{2,5}\s+[0-9]{3,4}\.\s*([^.]+)\.", 1).alias("title"),
        F.regexp_extract("block", r"([0-9]+)(?:-[0-9]+)?\s+[Cc]redit", 1).try_cast("int").alias("credits"),
        F.substring(F.regexp_extract("block", r"[Cc]redits?\.?\s*(.*?)(?:Prerequisite|Corequisite|Satisfies|$)", 1), 1, 500).alias("description"),
        F.regexp_extract("block", r"Prerequisites?:\s*([^.]+)\.", 1).alias("prerequisites"),
        F.regexp_extract("block", r"Corequisites?:\s*([^.]+)\.", 1).alias("corequisites"),
        F.regexp_extract("block", r"Satisfies:\s*([^.]+)\.", 1).alias("core"),
    )


# Words of a section's header and the bucket of its courses; the first rule counts.
BUCKETS = (("math", "math"), ("basic_science", "science"), ("electives", "elective"), ("core", "core|required"))


def program_hours(text: Column) -> Column:
    """Total credit hours that the text names."""
    return F.regexp_extract(text, r"(?i)([0-9]{2,3})\s+(?:total\s+)?credit\s+hours", 1).try_cast("int")


def program_gpas(text: Column) -> Column:
    """"kind: number" of each GPA that the text names, in order."""
    kinds, numbers = (F.regexp_extract_all(text, F.lit(r"(?i)(overall|major|minimum|cumulative)\s+gpa\s+(?:of\s+)?([0-9]\.[0-9]+)"), F.lit(i)) for i in (1, 2))
    return F.zip_with(kinds, numbers, lambda k, n: F.concat_ws(": ", F.lower(k), n))


def course_buckets(sections: DataFrame, key: str, header: str, body: str) -> DataFrame:
    """(key, bucket, code): codes of the sections' bodies by the rule that fits the header."""
    low = F.lower(header)
    bucket = F.coalesce(*[F.when(low.rlike(p), F.lit(b)) for b, p in BUCKETS], F.lit("other"))
    return sections.select(key, bucket.alias("bucket"), F.explode(course_codes(F.col(body), r"([A-Z]{2,5})\s?([0-9]{3,4})")).alias("code")).distinct()
