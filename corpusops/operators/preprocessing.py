"""Preprocessing of question tables: normal form, codes, synonyms and spelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusops.functions import text as T
from corpusops.operators.phrases import occurring


def correct(words: DataFrame, vocabulary: DataFrame, column: str, least: float = 85.0, shortest: int = 3) -> DataFrame:
    """(word, correction, similarity) of each distinct word that isn't in the vocabulary: its most similar word
    of the vocabulary if that reaches `least`, ties to the smaller word. Words under `shortest` characters have none.

    From 80 percent on, a word meets the vocabulary by its pairs of letters, in an equi-join; a smaller limit is for
    vocabularies that are small lists, as each word meets all of them whose length allows the similarity."""
    known = vocabulary.select(F.col(column).alias("known")).distinct()
    unknown = words.select(F.col(column).alias("word")).distinct().join(known, F.col("word") == F.col("known"), "left_anti").where(F.length("word") >= shortest)
    if least >= 80:  # so like, two words have two letters in a row in common or, if they are short, a letter
        cut = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n)))
        runs = lambda c: F.explode(F.array_distinct(F.when(F.length(c) <= 3, F.concat(cut(c, 1), cut(c, 2))).otherwise(cut(c, 2)))).alias("_run")
        met = unknown.select("word", runs("word")).join(known.select("known", runs("known")), "_run").select("word", "known").distinct()
    else:
        met = unknown.crossJoin(known)
    n, m = F.length("word"), F.length("known")
    sized = met.where(200 * F.least(n, m) >= least * (n + m))
    scored = sized.select("word", "known", F.round(T.lcs_ratio(F.col("word"), F.col("known")), 4).alias("similarity"))
    best = scored.where(F.col("similarity") >= least).groupBy("word").agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "known")).alias("best"))
    return best.select("word", F.col("best.known").alias("correction"), (-F.col("best.neg")).alias("similarity"))


def detect_codes(questions: DataFrame, subjects: DataFrame, least: float = 80.0) -> DataFrame:
    """(query_id, tokens, codes) of (query_id, tokens): read left to right, AB123 is "AB 123"; a known subject and the
    number after it are one code, and the subject is one too; a known subject alone is one; and an unknown word of
    two to four letters is the subject most like it, if it is alike enough. subjects: (subject)."""
    order = Window.partitionBy("query_id").orderBy("pos")
    known = subjects.select(F.upper("subject").alias("_up"), F.lit(True).alias("known")).distinct()
    rows = questions.select("query_id", F.posexplode("tokens").alias("pos", "token")).withColumn("_up", F.upper("token")).join(known, "_up", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    digits = F.col("token").rlike("^[0-9]+$")
    rows = rows.withColumns({"number": F.when(F.lead(digits).over(order), F.lead("token").over(order)), "taken": digits & F.coalesce(F.lag("known").over(order), F.lit(False))})
    like = correct(rows.where(~F.col("known") & F.col("token").rlike("^[a-zA-Z]{2,4}$")).select(F.col("_up").alias("word")), known.select(F.col("_up").alias("word")), "word", least, shortest=2)
    rows = rows.join(like.select(F.col("word").alias("_up"), "correction"), "_up", "left").where(~F.col("taken"))
    joined = F.regexp_extract("_up", "^([A-Z]{2,4})([0-9]{3,4})$", 1)
    fuzzy = F.col("token").rlike("^[a-zA-Z]{2,4}$") & F.col("correction").isNotNull()
    both = F.concat_ws(" ", "_up", "number")
    code = F.when(joined != "", F.array(F.concat_ws(" ", joined, F.regexp_extract("_up", "([0-9]+)$", 1)))).when(F.col("known") & F.col("number").isNotNull(), F.array(F.col("_up"), both)).when(F.col("known"), F.array("_up")).when(fuzzy, F.array("correction")).otherwise(F.array().cast("array<string>"))
    token = F.when(F.size(code) > 0, F.element_at(code, -1)).otherwise(F.col("token"))
    # a question's tokens only
    out = rows.select("query_id", "pos", token.alias("token"), code.alias("code")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "code"))).alias("all"))
    found = out.select("query_id", F.col("all.token").alias("tokens"), F.flatten(F.col("all.code")).alias("codes"))
    empty = F.array().cast("array<string>")
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("tokens", empty).alias("tokens"), F.coalesce("codes", empty).alias("codes"))


def expand(tokens: Column, synonyms: Mapping[str, str], codes: Sequence[str]) -> Column:
    """(tokens, corrections) with synonyms, read left to right: a key of two words before one of one word. Upper-case
    words of up to five characters stay, and a word that is a code becomes it."""
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    known = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    stays = lambda t: (F.length(t) <= 5) & (t == F.upper(t)) & (F.upper(t) != F.lower(t))

    def fold(ts: Column) -> Column:
        low = F.transform(ts, lambda t: F.when(~stays(t), F.lower(t)))
        two = F.transform(low, lambda t, i: F.when(F.get(ts, i + 1).isNotNull(), F.concat_ws(" ", t, F.lower(F.get(ts, i + 1)))))
        pairs = F.transform(two, lambda k, i: F.when(F.get(low, i).isNotNull() & F.try_element_at(table, k).isNotNull(), k))
        return T.bound(pairs, lambda ps: T.bound(T.starts(ps), lambda at: F.filter(F.transform(ts, lambda t, i: one(ps, at, t, i)), lambda x: x.isNotNull())))

    def one(pairs: Column, at: Column, t: Column, i: Column) -> Column:
        low = F.lower(t)
        single = F.when(~stays(t) & F.try_element_at(table, low).isNotNull(), low)
        key = F.when(F.array_contains(at, i), F.get(pairs, i)).when(~F.array_contains(known, F.upper(t)), single)
        upper = single.isNotNull() & F.array_contains(known, F.upper(t)) & ~F.array_contains(at, i)
        new = F.when(key.isNotNull(), F.try_element_at(table, key)).when(upper, F.upper(t)).otherwise(t)
        return F.when(~F.array_contains(at, i - 1), F.struct(new.alias("token"), key.alias("original")))

    done = T.bound(tokens, fold)
    corrections = F.transform(F.filter(done, lambda x: x["original"].isNotNull()), lambda x: F.struct(F.lit("synonym").alias("type"), x["original"].alias("original"), x["token"].alias("corrected")))
    return F.struct(F.flatten(F.transform(done, lambda x: F.when(x["original"].isNotNull(), F.split(x["token"], " ")).otherwise(F.array(x["token"])))).alias("tokens"), corrections.alias("corrections"))


def correct_typos(questions: DataFrame, vocabulary: DataFrame, protected: Sequence[str] = (), least: float = 85.0) -> DataFrame:
    """(query_id, tokens, corrections) of (query_id, tokens): words that are not protected, in upper case, numbers, of
    two characters or in the vocabulary become the vocabulary word most like them, if it is alike enough. Each
    distinct unknown word is compared once. vocabulary: (word)."""
    rows = questions.select("query_id", F.posexplode("tokens").alias("pos", "token")).withColumn("word", F.lower("token"))
    token = F.col("token")
    upper = (token == F.upper(token)) & (F.upper(token) != F.lower(token))
    open_ = ~F.col("word").isin(list(protected)) & ~upper & ~token.rlike("^[0-9]+$") & (F.length(token) > 2)
    better = correct(rows.where(open_).select("word"), vocabulary.select(F.lower("word").alias("word")), "word", least).select(F.col("word").alias("_of"), "correction")
    met = rows.withColumn("_of", F.when(open_, F.col("word"))).join(better, "_of", "left")
    # a question's tokens only
    out = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("correction", "token").alias("token"), F.when(F.col("correction").isNotNull(), token).alias("original")))).alias("all"))
    done = F.transform(F.filter("all", lambda x: x["original"].isNotNull()), lambda x: F.struct(F.lit("typo").alias("type"), x["original"].alias("original"), x["token"].alias("corrected")))
    empty = F.array().cast("array<string>")
    found = out.select("query_id", F.col("all.token").alias("tokens"), done.alias("corrections"))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("tokens", empty).alias("tokens"), F.coalesce("corrections", F.array().cast("array<struct<type:string,original:string,corrected:string>>")).alias("corrections"))


def preprocess(questions: DataFrame, synonyms: Mapping[str, str], subjects: Sequence[str], vocabulary: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """(query_id, original, normal, processed, codes, corrections) of (query_id, text): normal form, codes, synonyms,
    spelling, in this order."""
    spark = questions.sparkSession
    normal = questions.select("query_id", F.col("text").alias("original"), T.normalize_query(F.col("text")).alias("normal"))
    tokens = normal.select("query_id", F.filter(F.split("normal", " "), lambda t: t != "").alias("tokens"))
    coded = detect_codes(tokens, spark.createDataFrame([(x,) for x in subjects], "subject string"))
    expanded = coded.select("query_id", "codes", expand(F.col("tokens"), synonyms, subjects).alias("e"))
    spelt = correct_typos(expanded.select("query_id", "e.tokens"), vocabulary, protected)
    out = expanded.select("query_id", "codes", F.col("e.corrections").alias("_synonyms")).join(spelt, "query_id").join(normal, "query_id")
    return out.select("query_id", "original", "normal", F.array_join("tokens", " ").alias("processed"), "codes", F.concat("_synonyms", "corrections").alias("corrections"))


def department_and_topic(text: Column, keywords: Mapping[str, Sequence[str]], structure: Sequence[str] = (), forms: Mapping[str, str] | None = None, light: Sequence[str] = ()) -> tuple[Column, Column]:
    """The first department with a keyword in the text; and the topic: the text without keywords and words of structure
    (wherever they stand), abbreviations written out. If less than three characters are left, the topic is the text
    without the words in `light` only."""
    low = F.lower(text)
    department = F.coalesce(*[F.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(name)) for name, words in keywords.items()])
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def without(words: Sequence[str]) -> Column:
        rest = low
        for w in words:
            rest = F.replace(rest, F.lit(w), F.lit(" "))
        return rest

    rest = squeezed(without([w for words in keywords.values() for w in words] + list(structure)))
    if forms:
        rest = F.array_join(T.expand_tokens(F.split(rest, " "), dict(forms)), " ")
    return department, F.when(F.length(rest) >= 3, rest).otherwise(squeezed(without(light)))


def alias_key(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the key of the first alias, by length and then by key, that a question's text holds; null without one.
    aliases: (alias, key)."""
    named = questions.select(F.lower("text").alias("_low")).distinct().select("_low", F.md5("_low").alias("_id"))
    held = occurring(named, aliases.select(F.lower("alias").alias("_alias")), "_low", "_alias", ["_id"])
    best = held.join(aliases.withColumn("_alias", F.lower("alias")), "_alias").groupBy("_id").agg(F.min(F.struct((-F.length("alias")).alias("n"), "key")).alias("best"))
    return questions.withColumn("_id", F.md5(F.lower("text"))).join(best.select("_id", "best.key"), "_id", "left").drop("_id")
