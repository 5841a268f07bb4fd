"""Column functions on texts and questions: tokens, normal forms, words and phrases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Words that carry no weight in lexical scoring.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might "
    "can shall to of in for on with at by from as into through during before above below between "
    "and but or not no nor so if then than too very just about up out that this it its i me my we our "
    "you your he she they them what which who whom how when where"
).split()

# Misspelt and short forms that mark a question as messy.
MESSY_TOKENS = (
    "machien machie artifical robtics quantim quantom profesors proffessor reseach compter avilable availble "
    "lerning introducton abt wnt noe wat u r ur tho bc cuz"
).split()


def strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def tokenize(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case runs of a-z and 0-9 that are no stopword and longer than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(list(stopwords)))


def normalize_query(text: Column) -> Column:
    """All but letters, digits, underscores, white space and hyphens become spaces; runs of white space
    one space; lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " ")))


def needs_cleaning(text: Column, messy: Sequence[str] = MESSY_TOKENS) -> Column:
    """Double spaces, ??? or !!!, or a messy word."""
    low = F.lower(text)
    tokens = F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))
    return low.contains("  ") | low.contains("???") | low.contains("!!!") | F.arrays_overlap(tokens, strings(messy))


def valid_query(text: Column) -> Column:
    """Not blank, and with a letter or digit."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def contains_word(text: Column, word: str) -> Column:
    """The word between spaces, as it is or with s or es."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return padded.contains(f" {word} ") | padded.contains(f" {word}s ") | padded.contains(f" {word}es ")


def has_any_token(text: Column, words: Sequence[str]) -> Column:
    """A token equals one of the words, or does with an s more or less."""
    forms = sorted({f for w in words for f in (w, f"{w}s", w.removesuffix("s"))})
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), strings(forms))


def expand_tokens(tokens: Column, forms: dict[str, str]) -> Column:
    """Each token that is a key becomes its value, once: what comes in isn't expanded again."""
    table = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(pairs: Column) -> Column:
    """The places of an array that isn't null where a pair is taken, left to right: none that the one before uses up."""
    places = F.filter(F.transform(pairs, lambda p, i: F.when(p.isNotNull(), i)), lambda i: i.isNotNull())
    return F.aggregate(places, F.array().cast("array<int>"), lambda done, i: F.when(F.array_contains(done, i - 1), done).otherwise(F.array_append(done, i)))


def expand_phrases(tokens: Column, forms: dict[str, str]) -> Column:
    """expand_tokens where keys may have two words; read left to right, a two-word key is taken before its
    first word. Only the places where one could start are folded over, as one may use up the next."""
    table = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])

    def expand(ts: Column) -> Column:
        two = F.zip_with(ts, F.slice(ts, 2, 1_000_000), lambda a, b: F.when(b.isNotNull(), F.try_element_at(table, F.concat_ws(" ", a, b))))
        return bound(two, lambda pairs: bound(starts(pairs), lambda at: F.transform(ts, lambda t, i: one(pairs, at, t, i))))

    def one(pairs: Column, at: Column, t: Column, i: Column) -> Column:
        return F.when(F.array_contains(at, i - 1), None).when(F.array_contains(at, i), F.get(pairs, i)).otherwise(F.coalesce(F.try_element_at(table, t), t))

    return F.array_compact(bound(tokens, expand))


def aliases(term: Column, forms: dict[str, str]) -> Column:
    """The term, its full form and its short form, as far as they exist."""
    there = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    back = F.create_map(*[F.lit(x) for short, full in forms.items() for x in (full, short)])
    low = F.lower(term)
    return F.array_distinct(F.array_compact(F.array(low, F.try_element_at(there, low), F.try_element_at(back, low))))


def without_words(text: Column, phrases: Sequence[str]) -> Column:
    """The text in lower case without the phrases as whole words, longest first."""
    body = "|".join(sorted(phrases, key=lambda p: (-len(p), p)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"\b({body})\b", " "), r"\s+", " "))


def topic_of(text: Column, filler: Sequence[str], code: str = r"\b([A-Z]{2,4}) ?([0-9]{3})\b") -> Column:
    """A course code if there is one; else what is left without filler, trimmed and in title case, unless it
    is shorter than three characters."""
    rest = F.initcap(F.regexp_replace(without_words(text, filler), r"^[^a-z]+|[^a-z]+$", ""))
    subject = F.regexp_extract(text, code, 1)
    return F.when(subject != "", F.concat_ws(" ", subject, F.regexp_extract(text, code, 2))).when(F.length(rest) >= 3, rest)


def lcs_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length a + length b), the InDel similarity in percent, by a row-wise fold."""
    bs = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(done: Column, i: Column) -> Column:
            best = F.when(F.element_at(bs, i) == x, F.element_at(before, i) + 1).otherwise(F.greatest(F.element_at(before, i + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(F.split(a, ""), zero, row), -1)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 200.0 * lcs / (F.length(a) + F.length(b))).otherwise(F.lit(0.0))


def truncate(text: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def truncate_at_newline(text: Column, n: int) -> Column:
    """Cut at the last line feed within the first n characters, or at n if there is none."""
    head = F.substring(text, 1, n)
    back = F.instr(F.reverse(head), "\n")
    return F.when(F.length(text) <= n, text).when(back > 0, F.substring(head, F.lit(1), F.length(head) - back)).otherwise(head)


def clean_text(text: Column) -> Column:
    """Runs of blanks are one space, runs of blank lines one blank line; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n[ \n]*\n", "\n\n"))


def slug(text: Column, longest: int | None = None) -> Column:
    out = F.lower(text)
    for a, b in ((" ", "_"), (",", ""), (".", ""), ("&", "and"), ("/", "_")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.substring(out, 1, longest) if longest else out


def humanize_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
