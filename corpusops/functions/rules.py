"""Rule-based classification of questions: column expressions over rule tables given as parameters.

Rules are constants, so they compile into the plan: one `rlike` each, in the scan, without a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from corpusops.functions.text import contains_word


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(F.greatest(*[text.rlike(p) for p in patterns], F.lit(False)), F.lit(False))


def any_substring(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.coalesce(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(False))


def score_intents(text: Column, rules: Mapping[str, Sequence[str]], seed: tuple[str, str, int] | None = None) -> Column:
    """(intent, score, confidence): a point for each matching pattern; ties go to the earlier intent. The
    seed (intent, pattern on the text as it is, points) puts its intent first when it matches. Without
    any match the intent is general, at 0.3."""
    low = F.lower(text)
    entries = []
    for i, (intent, patterns) in enumerate(rules.items()):
        points, order = sum((low.rlike(p).cast("int") for p in patterns[1:]), low.rlike(patterns[0]).cast("int")), F.lit(-i - 1)
        if seed and seed[0] == intent:
            found = text.rlike(seed[1])
            points, order = points + F.when(found, seed[2]).otherwise(0), F.when(found, 0).otherwise(order)
        entries.append(F.struct(points.alias("score"), order.alias("order"), F.lit(intent).alias("intent")))
    best = F.array_max(F.array(*entries))
    hit = F.coalesce(best["score"] > 0, F.lit(False))
    return F.struct(
        F.when(hit, best["intent"]).otherwise("general").alias("intent"),
        F.when(hit, best["score"]).otherwise(0).alias("score"),
        F.when(hit, F.least(F.lit(0.95), F.round(0.6 + 0.15 * best["score"], 6))).otherwise(0.3).alias("confidence"),
    )


def override_intent(text: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The first rule (pattern, intent) that matches, at confidence 0.9, else the struct `otherwise`."""
    low = F.lower(text)
    named = F.coalesce(*[F.when(low.rlike(p), F.lit(i)) for p, i in rules])
    return F.when(named.isNotNull(), F.struct(named.alias("intent"), F.lit(1).alias("score"), F.lit(0.9).alias("confidence"))).otherwise(otherwise)


def first_alias(text: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The first name of which an alias is a word of the text, else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"\b({'|'.join(words)})\b"), F.lit(name)) for name, words in aliases.items()])


def person_name(text: Column, titles: Sequence[str] = ("Dr", "Prof", "Professor", "Mr", "Ms")) -> Column:
    """A name after a title, or before 's; case matters."""
    titled = F.regexp_extract(text, rf"\b(?:{'|'.join(titles)})\.? ([A-Z][a-z]+(?: [A-Z][a-z]+)*)", 1)
    owner = F.regexp_extract(text, r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)'s\b", 1)
    return F.coalesce(F.nullif(titled, F.lit("")), F.nullif(owner, F.lit("")))


def course_entities(text: Column) -> Column:
    """(code, subject, level, credits) as far as the text names them."""
    low = F.lower(text)
    subject, number = (F.regexp_extract(text, r"\b([A-Z]{2,4})\s*([0-9]{3,4})\b", i) for i in (1, 2))
    level = F.when(low.contains("undergrad"), "undergraduate").when(low.contains("grad"), "graduate")
    credits = F.regexp_extract(low, r"\b([0-9])[- ]*(?:credit|hour)", 1)
    return F.struct(F.when(subject != "", F.concat_ws(" ", subject, number)).alias("code"), F.nullif(subject, F.lit("")).alias("subject"), level.alias("level"), credits.try_cast("int").alias("credits"))


def scope_of(text: Column, patterns: Sequence[str]) -> Column:
    return F.when(any_pattern(F.lower(text), patterns), "complete_list").otherwise("top_results")


def cue_guard(intent: Column, text: Column, guarded: str, cues: Sequence[str]) -> Column:
    """The guarded intent becomes general where the text has none of its cues."""
    return F.when((intent == guarded) & ~any_pattern(F.lower(text), cues), "general").otherwise(intent)


def domain_flags(text: Column, domains: Mapping[str, Sequence[str]], suppress: Mapping[str, str] | None = None) -> Column:
    """Names of the domains of which the text has a word; a domain drops the one it suppresses."""
    flags = {d: F.greatest(*[contains_word(text, w) for w in words], F.lit(False)) for d, words in domains.items()}
    for winner, loser in (suppress or {}).items():
        flags[loser] = flags[loser] & ~flags[winner]
    return F.array_compact(F.array(*[F.when(f, F.lit(d)) for d, f in flags.items()]))


def first_keyword_type(text: Column, types: Mapping[str, Sequence[str]], otherwise: str = "general") -> Column:
    return F.coalesce(*[F.when(any_substring(text, words), F.lit(name)) for name, words in types.items()], F.lit(otherwise))


def canonical(text: Column, names: Mapping[str, Sequence[str]]) -> Column:
    """The first name with a keyword in the text, else null."""
    return F.coalesce(*[F.when(any_substring(text, words), F.lit(name)) for name, words in names.items()])


def keyword_intent(text: Column, types: Mapping[str, Sequence[str]], code: str = r"\b[A-Z]{2,4} ?[0-9]{3}\b") -> Column:
    """(intent, confidence): the first type with a keyword at 0.8, a course code at 0.9, else nothing."""
    named = F.coalesce(*[F.when(any_substring(text, words), F.lit(name)) for name, words in types.items()])
    return F.struct(F.when(named.isNotNull(), named).when(text.rlike(code), "course").alias("intent"), F.when(named.isNotNull(), 0.8).when(text.rlike(code), 0.9).alias("confidence"))


def turn_type(
    text: Column, has_history: Column, greetings: Sequence[str], about: Sequence[str], allowed: Sequence[str], blocked: Sequence[str],
    departments: Sequence[str], vague: Sequence[str], pronouns: str, cues: str, question_words: str, asked: Column,
) -> Column:
    """What a user's turn is: follow_up, clarification_answer, greeting, about_bot, off_topic,
    department_filter, ambiguous or question; the first that holds.

    asked: whether the turn before put a question to the user."""
    low = F.lower(F.trim(text))
    bare = F.regexp_replace(low, r"[?!.]+$", "")
    words = F.size(F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0)))
    greeting = F.greatest(*[(bare == g) | (bare.rlike(rf"^{g}[ !?,.\t]") & (F.length(bare) < len(g) + 20)) for g in greetings], F.lit(False))
    follow = (has_history & low.rlike(pronouns)) | ((words <= 8) & low.rlike(cues))
    answer = asked & (words <= 4) & (words > 0) & ~low.contains("?") & ~low.rlike(question_words)
    off = ~any_substring(text, allowed) & any_pattern(low, blocked)
    department = low.rlike("only|just") & any_substring(text, departments)
    ambiguous = (words < 3) & low.isin(list(vague))
    return (
        F.when(follow, "follow_up").when(answer, "clarification_answer").when(greeting, "greeting").when(any_substring(text, about), "about_bot")
        .when(off, "off_topic").when(department, "department_filter").when(ambiguous, "ambiguous").otherwise("question")
    )
