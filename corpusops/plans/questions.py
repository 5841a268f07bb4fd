"""Queries on question preprocessing, classification and decomposition. The tables hold invented prose, so
the rules here use the words that occur in it; rule tables are parameters of every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusops.functions import decompose as Q, rules as C, text as T
from corpusops.operators import lexical as L, preprocessing as F2, rule_tables as RT
from corpusops.operators.embedding import intent_by_anchors, letter_shares
from corpusops.plans.registry import query, read
from corpusops.plans.retrieval import IDF, TOKENS, documents, sql_tokens, standing

CODES = ["AB", "CS", "MATH", "PHYS", "BRAND"]
SYNONYMS = {"the": "der", "and": "und", "of": "von", "of the": "vom", "to": "zu"}
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf)


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_or(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# --- preprocessing --------------------------------------------------------------------------------------


@query("normalize_query", r"SELECT conv_id, turn, trim(lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS normal FROM conversations")
def _(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.normalize_query(F.col("text")).alias("normal"))


NAMES = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(left(p_brand, 5)) || (p_size + 100) WHEN p_partkey % 3 = 1 THEN 'cs ' || (p_size + 200) || ' and math' ELSE p_name || ' phys' END AS text FROM part"


def named(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with course codes made from parts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 3 == 0, F.concat(F.upper(F.substring("p_brand", 1, 5)), (size + 100).cast("string"))).when(k % 3 == 1, F.concat(F.lit("cs "), (size + 200).cast("string"), F.lit(" and math"))).otherwise(F.concat("p_name", F.lit(" phys")))
    return read(spark, sf, "part").select("p_partkey", text.alias("text"))


#: Parts as questions with codes: joined, apart, alone, and misspelt.
SPOKEN = "SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'eecs' || (p_size + 100) || ' now' WHEN 1 THEN 'cs ' || (p_size + 200) || ' and math' WHEN 2 THEN p_name || ' phys' ELSE 'mth or phy 101 ' || p_size END AS text FROM part"


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.concat(F.lit("eecs"), (size + 100).cast("string"), F.lit(" now"))).when(k % 4 == 1, F.concat(F.lit("cs "), (size + 200).cast("string"), F.lit(" and math"))).when(k % 4 == 2, F.concat("p_name", F.lit(" phys"))).otherwise(F.concat(F.lit("mth or phy 101 "), size.cast("string")))
    return read(spark, sf, "part").select(k.alias("query_id"), text.alias("text"))


def sql_like(name: str, words: str, known: str, least: int) -> str:
    """Tables name_l and name (word, best): for each of words(word) the most similar of known(known). The longest common
    subsequence is counted in the bits of a number, one letter of the word a step."""
    return f"""{name}_l(word, known, i, v) AS (SELECT word, known, 1, (1::BIGINT << length(known)) - 1 FROM {words}, {known} WHERE 200 * least(length(word), length(known)) >= {least} * (length(word) + length(known))
    UNION ALL SELECT word, known, i + 1, ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(known)) - 1) FROM (SELECT *, CAST(list_sum(list_transform(range(1, length(known) + 1), lambda j: CASE WHEN known[j] = word[i] THEN 1::BIGINT << (j - 1) ELSE 0 END)) AS BIGINT) AS m FROM {name}_l WHERE i <= length(word))),
  {name} AS (SELECT word, min_by(known, (-lcs, known)) AS best FROM (SELECT word, known, 200.0 * (length(known) - bit_count(v)) / (length(word) + length(known)) AS lcs FROM {name}_l WHERE i = length(word) + 1) WHERE lcs >= {least} GROUP BY word)"""


def sql_codes(source: str, out: str) -> str:
    """Table out (query_id, i, token, code list) of the tokens source (query_id, i, w)."""
    return f"""{out}_x AS (SELECT *, upper(w) AS u, list_contains({sql_list(CODES)}, upper(w)) AS known, lead(w) OVER o AS nxt, lag(w) OVER o AS prev FROM {source} WINDOW o AS (PARTITION BY query_id ORDER BY i)),
  {out}_w AS (SELECT DISTINCT u AS word FROM {out}_x WHERE NOT known AND regexp_matches(w, '^[a-zA-Z]{{2,4}}$')), {out}_k AS (SELECT unnest({sql_list(CODES)}) AS known), {sql_like(out + '_b', out + '_w', out + '_k', 80)},
  {out}_c AS (SELECT query_id, i, w, CASE WHEN regexp_matches(u, '^[A-Z]{{2,4}}[0-9]{{3,4}}$') THEN [regexp_replace(u, '^([A-Z]+)([0-9]+)$', '\\1 \\2')] WHEN known AND coalesce(regexp_matches(nxt, '^[0-9]+$'), false) THEN [u, u || ' ' || nxt] WHEN known THEN [u]
    WHEN best IS NOT NULL AND regexp_matches(w, '^[a-zA-Z]{{2,4}}$') THEN [best] ELSE [] END AS code FROM {out}_x LEFT JOIN {out}_b ON word = u WHERE NOT (regexp_matches(w, '^[0-9]+$') AND coalesce(list_contains({sql_list(CODES)}, upper(prev)), false))),
  {out} AS (SELECT query_id, i, CASE WHEN len(code) > 0 THEN code[-1] ELSE w END AS token, code FROM {out}_c)"""


def sql_typos(source: str, known: str, out: str) -> str:
    """Table out (query_id, i, token, original) of source (query_id, i, token), protected words being 'the' and 'and'."""
    upper = "token = upper(token) AND upper(token) <> lower(token)"
    return f"""{out}_o AS (SELECT *, lower(token) NOT IN ('the', 'and') AND NOT ({upper}) AND NOT regexp_matches(token, '^[0-9]+$') AND length(token) > 2 AND lower(token) NOT IN (SELECT known FROM {known}) AS open FROM {source}),
  {out}_w AS (SELECT DISTINCT lower(token) AS word FROM {out}_o WHERE open), {sql_like(out + '_b', out + '_w', known, 85)},
  {out} AS (SELECT query_id, i, coalesce(best, token) AS token, CASE WHEN best IS NOT NULL THEN token END AS original FROM {out}_o LEFT JOIN {out}_b ON open AND word = lower(token))"""


@query("detect_codes", f"""WITH RECURSIVE n AS ({SPOKEN}), t AS (SELECT query_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM n), {sql_codes('t', 'c')}
  SELECT query_id, string_agg(token, ' ' ORDER BY i) AS processed, array_to_string(flatten(list(code ORDER BY i)), '|') AS codes FROM c GROUP BY query_id""")
def _(spark, sf):
    """Codes, the misspelt ones too, and the question with them."""
    asked = spoken(spark, sf).select("query_id", F.split("text", " ").alias("tokens"))
    found = F2.detect_codes(asked, spark.createDataFrame([(c,) for c in CODES], "subject string"))
    return found.select("query_id", F.array_join("tokens", " ").alias("processed"), F.array_join("codes", "|").alias("codes"))


#: Words of parts' names with two letters swapped, and words that are no business of the speller.
TYPED = "SELECT p_partkey AS query_id, list_transform(string_split(p_name, ' '), lambda w: CASE WHEN p_partkey % 2 = 0 THEN w[2] || w[1] || w[3:] ELSE w[1:3] || w[5] || w[4] || w[6:] END) || ['the', 'CS', '12', upper(p_type)] AS words FROM part"


def part_words(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


@query("correct_typos", f"""WITH RECURSIVE y AS ({TYPED}), t AS (SELECT query_id, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM y), k AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS known FROM part), {sql_typos('t', 'k', 'c')}
  SELECT query_id, string_agg(token, ' ' ORDER BY i) AS processed, coalesce(string_agg(original, '|' ORDER BY i), '') AS corrected FROM c GROUP BY query_id""")
def _(spark, sf):
    """Misspelt words of part names, corrected by the names' own words."""
    swapped = lambda w: F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substring(w, 3, 100))).otherwise(F.concat(F.substring(w, 1, 3), F.substring(w, 5, 1), F.substring(w, 4, 1), F.substring(w, 6, 100)))
    tokens = F.concat(F.transform(F.split("p_name", " "), swapped), F.array(F.lit("the"), F.lit("CS"), F.lit("12"), F.upper("p_type")))
    asked = read(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), tokens.alias("tokens"))
    done = F2.correct_typos(asked, part_words(spark, sf), ["the", "and"])
    return done.select("query_id", F.array_join("tokens", " ").alias("processed"), F.array_join(F.col("corrections.original"), "|").alias("corrected"))


@query("needs_cleaning", f"""SELECT conv_id, turn, contains(lower(text), '  ') OR contains(text, '???') OR contains(text, '!!!') OR len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9'']+'), {sql_list(T.MESSY_TOKENS)})) > 0 AS messy FROM conversations""")
def _(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.needs_cleaning(F.col("text")).alias("messy"))


@query("valid_query", r"SELECT doc_id, regexp_matches(text, '[\p{L}\p{N}]') AS valid FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.valid_query(F.col("text")).alias("valid"))


@query("contains_word", "SELECT doc_id, contains(' ' || lower(text) || ' ', ' inth ') OR contains(' ' || lower(text) || ' ', ' inths ') OR contains(' ' || lower(text) || ' ', ' inthes ') AS has FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.contains_word(F.col("text"), "inth").alias("has"))


@query("has_any_token", "SELECT doc_id, len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]+'), ['reth', 'reths', 'ndes', 'nde', 'ndess'])) > 0 AS has FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.has_any_token(F.col("text"), ["reth", "ndes"]).alias("has"))


FILLER = ["tell me about", "the", "and", "of", "is", "that", "der", "die", "und", "la", "les", "de"]


ASCII = "(SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM conversations)"


TOPICS = f"""WITH r AS (SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace(lower(text), '\\b({"|".join(sorted(FILLER, key=lambda p: (-len(p), p)))})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS rest FROM {ASCII}),
  e AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(rest, '^[^a-z]+|[^a-z]+$', '', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS named, regexp_extract(text, '\\b([A-Z]{{2,4}}) ?([0-9]{{3}})\\b', 1) AS subject FROM r),
  topics AS (SELECT conv_id, turn, text, CASE WHEN subject <> '' THEN subject || ' ' || regexp_extract(text, '\\b([A-Z]{{2,4}}) ?([0-9]{{3}})\\b', 2) WHEN length(named) >= 3 THEN named END AS topic FROM e)"""


@query("topic_of", TOPICS + " SELECT conv_id, turn, topic FROM topics")
def _(spark, sf):
    """Letters beyond ASCII are another letter here, as word boundaries of the SQL know ASCII only."""
    said = turns(spark, sf).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "x"))
    return said.select("conv_id", "turn", T.topic_of(F.col("text"), FILLER).alias("topic"))


@query("expand_abbreviations", f"SELECT doc_id, md5(array_to_string(list_transform({WORDS}, lambda w: CASE w WHEN 'the' THEN 'der' WHEN 'and' THEN 'und' WHEN 'of' THEN 'von' WHEN 'to' THEN 'zu' ELSE w END), ' ')) AS expanded FROM documents")
def _(spark, sf):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return docs(spark, sf).select("doc_id", F.md5(F.concat_ws(" ", T.expand_tokens(tokens, {k: v for k, v in SYNONYMS.items() if " " not in k}))).alias("expanded"))


def sql_synonyms(source: str, out: str) -> str:
    """Table out (query_id, i, token, original) of source (query_id, i, token): "of the" before single words."""
    stays = "length(token) <= 5 AND token = upper(token) AND upper(token) <> lower(token)"
    single = "CASE lower(token) WHEN 'the' THEN 'der' WHEN 'and' THEN 'und' WHEN 'of' THEN 'von' WHEN 'to' THEN 'zu' END"
    return f"""{out}_s AS (SELECT *, {stays} AS stays, NOT ({stays}) AND lower(token) = 'of' AND lower(lead(token) OVER o) = 'the' AS pair FROM {source} WINDOW o AS (PARTITION BY query_id ORDER BY i)),
  {out}_p AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY query_id ORDER BY i), false) AS taken FROM {out}_s),
  {out} AS (SELECT query_id, i, CASE WHEN pair THEN 'vom' WHEN stays THEN token ELSE coalesce({single}, token) END AS token, CASE WHEN pair THEN 'of the' WHEN NOT stays AND {single} IS NOT NULL THEN lower(token) END AS original FROM {out}_p WHERE NOT taken)"""


@query("expand_synonyms", f"""WITH t AS (SELECT conv_id * 1000 + turn AS query_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations), {sql_synonyms('t', 'c')}
  SELECT query_id, md5(string_agg(token, ' ' ORDER BY i)) AS expanded, md5(coalesce(string_agg(original, '|' ORDER BY i), '')) AS corrected FROM c GROUP BY query_id""")
def _(spark, sf):
    """Two-word keys first; upper-case words stay."""
    e = F2.expand(F.split("text", " "), SYNONYMS, CODES)
    done = turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), e.alias("e"))
    return done.select("query_id", F.md5(F.array_join("e.tokens", " ")).alias("expanded"), F.md5(F.array_join(F.col("e.corrections.original"), "|")).alias("corrected"))


@query("bidirectional_aliases", "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'economy|eco' WHEN 'eco' THEN 'eco|economy' WHEN 'standard' THEN 'standard|std' ELSE lower(p_type) END AS terms FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(T.aliases(F.col("p_type"), {"eco": "economy", "std": "standard"}), "|").alias("terms"))


PRE = r"trim(lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g')))"


#: The text of each benchmark item and a misspelt part name and code.
PUT = "SELECT item_id AS query_id, text, text || ' ' || coalesce(p_name[1:3] || p_name[5] || p_name[4] || p_name[6:], '') || ' mth 12' || item_id % 10 AS typed FROM benchmark LEFT JOIN part ON p_partkey = item_id"
PREPARED = f"""WITH RECURSIVE q AS ({PUT}), n AS (SELECT query_id, text, typed, {PRE.replace('text', 'typed')} AS normal FROM q), t AS (SELECT query_id, unnest(string_split(normal, ' ')) AS w, generate_subscripts(string_split(normal, ' '), 1) AS i FROM n WHERE normal <> ''),
  {sql_codes('t', 'c')}, {sql_synonyms('c', 's')}, s2 AS (SELECT query_id, i, unnest(CASE WHEN original IS NULL THEN [token] ELSE string_split(token, ' ') END) AS token FROM s), k AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS known FROM part), {sql_typos('s2', 'k', 'y')},
  done AS (SELECT query_id, string_agg(token, ' ' ORDER BY i) AS processed, string_agg(original, '|' ORDER BY i) AS typos FROM y GROUP BY query_id), syn AS (SELECT query_id, string_agg(original, '|' ORDER BY i) AS synonyms FROM s GROUP BY query_id),
  cod AS (SELECT query_id, array_to_string(flatten(list(code ORDER BY i)), '|') AS codes FROM c GROUP BY query_id)"""


def put(spark: SparkSession, sf: str) -> DataFrame:
    swapped = F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 1), F.substring("p_name", 4, 1), F.substring("p_name", 6, 100))
    rows = read(spark, sf, "benchmark").join(read(spark, sf, "part"), F.col("p_partkey") == F.col("item_id"), "left")
    typed = F.concat("text", F.lit(" "), F.coalesce(swapped, F.lit("")), F.lit(" mth 12"), (F.col("item_id") % 10).cast("string"))
    return rows.select(F.col("item_id").alias("query_id"), F.col("text").alias("said"), typed.alias("text"))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return F2.preprocess(put(spark, sf).select("query_id", "text"), SYNONYMS, CODES, part_words(spark, sf), ["the", "and"])


@query("preprocess", PREPARED + " SELECT n.query_id, normal, processed, codes, concat_ws('|', synonyms, typos) AS corrected FROM n JOIN done USING (query_id) JOIN syn USING (query_id) JOIN cod USING (query_id)")
def _(spark, sf):
    """Normal form, codes, synonyms and spelling of every question."""
    return prepared(spark, sf).select("query_id", "normal", "processed", F.array_join("codes", "|").alias("codes"), F.array_join(F.col("corrections.original"), "|").alias("corrected"))


@query("clean_hybrid", PREPARED + """, m AS (SELECT query_id, typed, contains(lower(typed), '  ') OR contains(typed, '???') OR contains(typed, '!!!') OR contains(typed, 'and') AS messy FROM n)
  SELECT query_id, CASE WHEN messy AND (synonyms IS NOT NULL OR typos IS NOT NULL) THEN processed ELSE typed END AS cleaned FROM m JOIN done USING (query_id) JOIN syn USING (query_id)""")
def _(spark, sf):
    """Preprocessed where a question needs cleaning (here also with "and" in it) and something was corrected."""
    text = F.col("original")
    messy = T.needs_cleaning(text, ["zzz"]) | text.contains("and")
    return prepared(spark, sf).select("query_id", F.when(messy & (F.size("corrections") > 0), F.col("processed")).otherwise(text).alias("cleaned"))


STRUCTURE, FORMS, LIGHT = ["and", "un"], {"re": "regarding", "th": "the"}, ["and"]


@query("department_and_topic", """WITH t AS (SELECT conv_id, turn, lower(text) AS l FROM conversations),
  r AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(l, 'tion', ' '), 'ing', ' '), 'the', ' '), 'and', ' '), 'un', ' '), '\\s+', ' ', 'g')) AS rest FROM t)
  SELECT conv_id, turn, CASE WHEN contains(l, 'tion') OR contains(l, 'ing') THEN 'english' WHEN contains(l, 'the') THEN 'general' END AS department,
    md5(CASE WHEN length(x) >= 3 THEN x ELSE trim(regexp_replace(replace(l, 'and', ' '), '\\s+', ' ', 'g')) END) AS topic FROM (SELECT *, array_to_string(list_transform(string_split(rest, ' '), lambda w: CASE w WHEN 're' THEN 'regarding' WHEN 'th' THEN 'the' ELSE w END), ' ') AS x FROM r)""")
def _(spark, sf):
    rows = turns(spark, sf)
    department, topic = F2.department_and_topic(F.col("text"), {"english": ["tion", "ing"], "general": ["the"]}, STRUCTURE, FORMS, LIGHT)
    return rows.select("conv_id", "turn", department.alias("department"), F.md5(topic).alias("topic"))


# --- rules ----------------------------------------------------------------------------------------------

INTENTS = {
    "article": [r"\b(the|a|an)\b", r"\bthis\b"],
    "ending": [r"tion\b", r"ing\b", r"ed\b"],
    "german": [r"\b(der|die|und)\b", r"\bvon\b"],
    "romance": [r"\b(la|les|de)\b", r"\b(que|el)\b"],
}
SEED = ("german", r"\b[A-Z]{2,4} ?[0-9]{3}\b", 3)


def sql_score(rules=INTENTS, seed=SEED, text="text") -> str:
    """score * 100 - order of each intent; the greatest one wins."""
    parts = []
    for i, (name, patterns) in enumerate(rules.items()):
        points = " + ".join(f"regexp_matches(lower({text}), '{p}')::INT" for p in patterns)
        found = f"regexp_matches({text}, '{seed[1]}')"
        parts.append(f"CASE WHEN {found} THEN ({points} + {seed[2]}) * 100 ELSE ({points}) * 100 - {i + 1} END" if seed and seed[0] == name else f"({points}) * 100 - {i + 1}")
    return f"greatest({', '.join(parts)})"


def sql_intent(code: str = "s", rules=INTENTS, seed=SEED) -> str:
    """Name of the winner of sql_score."""
    arms = " ".join(f"WHEN {code} % 100 = {(100 - i - 1) % 100} THEN '{name}'" for i, name in enumerate(rules))
    return f"CASE WHEN {code} <= 0 THEN 'general' WHEN {code} % 100 = 0 THEN '{seed[0]}' {arms} END"


#: The turns with another letter in place of each letter beyond ASCII: DuckDB's word boundaries know ASCII only.
PLAIN = "(SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM conversations) p"
SCORED = f"WITH k AS (SELECT conv_id, turn, text, {sql_score()} AS s FROM {PLAIN}), c AS (SELECT conv_id, turn, text, {sql_intent()} AS intent, CASE WHEN s <= 0 THEN 0 ELSE CAST(ceil(s / 100.0) AS INT) END AS score FROM k), i AS (SELECT *, CASE WHEN score = 0 THEN 0.3 ELSE least(0.95, round(0.6 + 0.15 * score, 6)) END::DOUBLE AS confidence FROM c)"


@query("score_intents", SCORED + " SELECT conv_id, turn, intent, score, confidence FROM i")
def _(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", C.score_intents(F.col("text"), INTENTS, SEED).alias("c")).select("conv_id", "turn", "c.intent", "c.score", "c.confidence")


@query("score_intents_table", SCORED + " SELECT conv_id, turn, intent, score, confidence FROM i")
def _(spark, sf):
    """The same rules as a table."""
    rules = spark.createDataFrame([(intent, i, p) for i, (intent, patterns) in enumerate(INTENTS.items()) for p in patterns], "intent string, place int, pattern string")
    return RT.intents_by_table(turns(spark, sf), rules, ["conv_id", "turn"], seed=SEED)


@query("override_intents", SCORED + " SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^the\\b') THEN 'opening' WHEN regexp_matches(lower(text), 'zz') THEN 'rare' ELSE intent END AS intent, CASE WHEN regexp_matches(lower(text), '^the\\b|zz') THEN 0.9 ELSE confidence END::DOUBLE AS confidence FROM i")
def _(spark, sf):
    c = C.override_intent(F.col("text"), [(r"^the\b", "opening"), ("zz", "rare")], C.score_intents(F.col("text"), INTENTS, SEED))
    return turns(spark, sf).select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.intent", "c.confidence")


@query("faculty_entities", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(the|this)\\b') THEN 'english' WHEN regexp_matches(lower(text), '\\b(der|und)\\b') THEN 'german' END AS department,
  CASE WHEN regexp_matches(lower(text), '\\b(on|of)\\b') THEN 'position' WHEN regexp_matches(lower(text), '\\b(is|are|que)\\b') THEN 'being' END AS research_area,
  nullif(regexp_extract(text, '\\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)''s\\b', 1), '') AS name FROM {PLAIN}""")
def _(spark, sf):
    text = F.col("text")
    return turns(spark, sf).select("conv_id", "turn", C.first_alias(text, {"english": ["the", "this"], "german": ["der", "und"]}).alias("department"), C.first_alias(text, {"position": ["on", "of"], "being": ["is", "are", "que"]}).alias("research_area"), C.person_name(text).alias("name"))


@query("course_entities", f"""WITH n AS ({NAMES}), u AS (SELECT p_partkey, upper(text) || CASE WHEN p_partkey % 5 = 0 THEN ' undergrad 3 credit' WHEN p_partkey % 5 = 1 THEN ' Grad' ELSE '' END AS t FROM n),
  s AS (SELECT *, regexp_extract(t, '\\b([A-Z]{{2,4}})\\s*([0-9]{{3,4}})\\b', 1) AS subject, regexp_extract(t, '\\b([A-Z]{{2,4}})\\s*([0-9]{{3,4}})\\b', 2) AS number FROM u)
  SELECT p_partkey, CASE WHEN subject <> '' THEN subject || ' ' || number END AS code, nullif(subject, '') AS subject, CASE WHEN contains(lower(t), 'undergrad') THEN 'undergraduate' WHEN contains(lower(t), 'grad') THEN 'graduate' END AS level,
    TRY_CAST(nullif(regexp_extract(lower(t), '\\b([0-9])[- ]*(?:credit|hour)', 1), '') AS INT) AS credits FROM s""")
def _(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.upper("text"), F.when(k % 5 == 0, " undergrad 3 credit").when(k % 5 == 1, " Grad").otherwise(""))
    return named(spark, sf).select("p_partkey", C.course_entities(text).alias("e")).select("p_partkey", "e.*")


@query("scope_of", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\ball\\b|\\bevery\\b|\\bhow many\\b|zz') THEN 'complete_list' ELSE 'top_results' END AS scope FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents) p")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", C.scope_of(F.col("text"), [r"\ball\b", r"\bevery\b", r"\bhow many\b", "zz"]).alias("scope"))


@query("lexical_cue_guard", SCORED + " SELECT conv_id, turn, CASE WHEN intent = 'ending' AND NOT regexp_matches(lower(text), 'eda|inga') THEN 'general' ELSE intent END AS intent FROM i")
def _(spark, sf):
    intent = C.score_intents(F.col("text"), INTENTS, SEED)["intent"]
    return turns(spark, sf).select("conv_id", "turn", C.cue_guard(intent, F.col("text"), "ending", ["eda", "inga"]).alias("intent"))


DOMAINS = {"english": ["the", "and"], "german": ["der", "und"], "french": ["les", "une"], "spanish": ["que", "una"]}


def sql_word(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(' ' || lower({text}) || ' ', ' {w}{e} ')" for w in words for e in ("", "s", "es")) + ")"


@query("domain_flags", f"""WITH f AS (SELECT doc_id, {', '.join(f'{sql_word("text", w)} AS {d}' for d, w in DOMAINS.items())} FROM documents)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN english THEN 'english' END, CASE WHEN german AND NOT english THEN 'german' END, CASE WHEN french THEN 'french' END, CASE WHEN spanish THEN 'spanish' END], lambda x: x IS NOT NULL), ',') AS domains FROM f""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(C.domain_flags(F.col("text"), DOMAINS, {"english": "german"}), ",").alias("domains"))


@query("first_keyword_type", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'tion') THEN 'action' WHEN contains(lower(text), 'ung') OR contains(lower(text), 'keit') THEN 'noun' ELSE 'general' END AS type FROM conversations")
def _(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", C.first_keyword_type(F.col("text"), {"action": ["tion"], "noun": ["ung", "keit"]}).alias("type"))


@query("keyword_intent", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'tion') THEN 'action' WHEN contains(lower(text), 'ung') THEN 'noun' WHEN regexp_matches(text, '\\b[A-Z]{2,4} ?[0-9]{3}\\b') THEN 'course' END AS intent, CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'ung') THEN 0.8 WHEN regexp_matches(text, '\\b[A-Z]{2,4} ?[0-9]{3}\\b') THEN 0.9 END::DOUBLE AS confidence FROM conversations")
def _(spark, sf):
    c = C.keyword_intent(F.col("text"), {"action": ["tion"], "noun": ["ung"]})
    return turns(spark, sf).select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.intent", "c.confidence")


@query("turn_type", f"""WITH t AS (SELECT conv_id, turn, text, lower(trim(text)) AS l, row_number() OVER w > 1 AS history, coalesce(contains(lag(text) OVER w, '?'), false) AS asked FROM {PLAIN} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  n AS (SELECT *, len(regexp_extract_all(l, '\\S+')) AS words, regexp_replace(l, '[?!.]+$', '') AS bare FROM t)
  SELECT conv_id, turn, CASE WHEN history AND regexp_matches(l, '\\b(he|she|it)\\b') OR words <= 8 AND regexp_matches(l, '\\b(this|that)\\b') THEN 'follow_up'
    WHEN asked AND words <= 4 AND words > 0 AND NOT contains(l, '?') AND NOT regexp_matches(l, '\\b(what|who|is|for)\\b') THEN 'clarification_answer'
    WHEN bare = 'the' OR regexp_matches(bare, '^the[ !?,.\\t]') AND length(bare) < 23 THEN 'greeting' WHEN contains(l, 'ingthe') THEN 'about_bot'
    WHEN NOT contains(l, 'tion') AND regexp_matches(l, '\\bare\\b') THEN 'off_topic' WHEN regexp_matches(l, 'only|just') AND contains(l, 'ed') THEN 'department_filter'
    WHEN words < 3 AND l IN ('help', 'info') THEN 'ambiguous' ELSE 'question' END AS type FROM n""")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, sf).withColumn("history", F.row_number().over(w) > 1).withColumn("asked", F.coalesce(F.lag("text").over(w).contains("?"), F.lit(False)))
    kind = C.turn_type(F.col("text"), F.col("history"), ["the"], ["ingthe"], ["tion"], [r"\bare\b"], ["ed"], ["help", "info"], r"\b(he|she|it)\b", r"\b(this|that)\b", r"\b(what|who|is|for)\b", F.col("asked"))
    return rows.select("conv_id", "turn", kind.alias("type"))


@query("context_domain", "SELECT a.doc_id, CASE WHEN contains(lower(a.text), 'tion') THEN 'english' WHEN contains(lower(a.text), 'ung') THEN 'german' ELSE 'other' END AS domain, CASE WHEN contains(lower(a.text), 'tion') THEN 'english' WHEN contains(lower(a.text), 'ung') THEN 'german' ELSE 'other' END <> CASE a.lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END AS mismatch FROM documents a")
def _(spark, sf):
    domain = C.first_keyword_type(F.col("text"), {"english": ["tion"], "german": ["ung"]}, "other")
    own = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "de", "german").otherwise("other")
    return docs(spark, sf).select("doc_id", domain.alias("domain"), (domain != own).alias("mismatch"))


@query("department_of", """WITH q AS (SELECT c_custkey, 'who is in ' || lower(n_name) || '?' AS text, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, CASE WHEN contains(text, 'an') THEN 'Department of An' WHEN contains(text, 'ia') OR contains(text, 'ru') THEN 'School of Ia' END AS department, n_nationkey AS key FROM q""")
def _(spark, sf):
    """The canonical name by keyword, and the key of the alias (a nation's name) in the question."""
    nations = read(spark, sf, "nation")
    asked = read(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("who is in "), F.lower("n_name"), F.lit("?")).alias("text"))
    aliases = nations.select(F.lower("n_name").alias("alias"), F.col("n_nationkey").alias("key"))
    found = F2.alias_key(asked, aliases)
    return found.select("c_custkey", C.canonical(F.col("text"), {"Department of An": ["an"], "School of Ia": ["ia", "ru"]}).alias("department"), "key")


ANCHORS = [("english", "the and that this with"), ("english", "tion ing over under"), ("german", "der die und nicht auch"), ("german", "sch ung keit heit"), ("spanish", "que los una para"), ("french", "les une dans pour eau")]
SHARES = "list_transform(range(97, 123), lambda i: (length({0}) - length(replace({0}, chr(i::INT), '')))::DOUBLE)"


@query("detect_intent", TOPICS + f""",
  u AS (SELECT conv_id, turn, {SHARES.format('lower(text)')} AS v FROM conversations), w(intent, phrase) AS (VALUES {", ".join(f"('{i}', '{x}')" for i, x in ANCHORS)}), z AS (SELECT intent, {SHARES.format('phrase')} AS v FROM w), y AS (SELECT intent, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM z),
  m AS (SELECT intent, list(x ORDER BY i) AS c FROM (SELECT intent, i, avg(x) AS x FROM (SELECT intent, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM y) GROUP BY ALL) GROUP BY intent),
  s AS (SELECT conv_id, turn, intent, round(CASE WHEN list_dot_product(v, v) > 0 THEN list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)) ELSE 0 END, 6) AS score FROM u, m), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, intent DESC) = 1),
  k AS (SELECT conv_id, turn, topic, CASE WHEN contains(lower(text), 'tion') THEN 'action' WHEN contains(lower(text), 'ung') THEN 'noun' WHEN regexp_matches(text, '\\b[A-Z]{{2,4}} ?[0-9]{{3}}\\b') THEN 'course' END AS word FROM topics WHERE topic IS NOT NULL)
  SELECT conv_id, turn, topic, CASE WHEN score >= 0.9 THEN intent ELSE word END AS intent FROM k JOIN b USING (conv_id, turn)""")
def _(spark, sf):
    """The intent of the nearest anchor phrases, else by keyword, of turns that have a topic."""
    said = turns(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    anchors = spark.createDataFrame(ANCHORS, "intent string, phrase string")
    near = intent_by_anchors(said, "id", "text", anchors, letter_shares, 0.9).withColumnRenamed("intent", "anchor")
    plain = said.withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "x"))
    told = plain.withColumn("topic", T.topic_of(F.col("text"), FILLER)).where("topic IS NOT NULL")
    words = C.keyword_intent(F.col("text"), {"action": ["tion"], "noun": ["ung"]})
    return told.join(near, "id", "left").select("conv_id", "turn", "topic", F.coalesce("anchor", words["intent"]).alias("intent"))


# --- decomposition --------------------------------------------------------------------------------------

ASKED = """SELECT p_partkey AS query_id, CASE p_partkey % 6 WHEN 0 THEN 'Compare CS ' || (p_size + 100) || ' and MATH ' || (p_size + 200) || ' credits?' WHEN 1 THEN 'compare ' || p_name || ' and ' || p_type || ' prerequisites?'
  WHEN 2 THEN 'prerequisites for ' || p_name || ', ' || p_type || ', and ' || p_brand || '?' WHEN 3 THEN 'tell me about ' || p_name || ', ' || p_brand || '?' WHEN 4 THEN 'Where is the ' || p_name || ' dining hall, and which bus goes there' ELSE p_name END AS text FROM part"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Compound questions made from parts."""
    text = F.expr("""CASE p_partkey % 6 WHEN 0 THEN concat('Compare CS ', p_size + 100, ' and MATH ', p_size + 200, ' credits?') WHEN 1 THEN concat('compare ', p_name, ' and ', p_type, ' prerequisites?')
      WHEN 2 THEN concat('prerequisites for ', p_name, ', ', p_type, ', and ', p_brand, '?') WHEN 3 THEN concat('tell me about ', p_name, ', ', p_brand, '?') WHEN 4 THEN concat('Where is the ', p_name, ' dining hall, and which bus goes there') ELSE p_name END""")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))


@query("should_decompose", f"WITH a AS ({ASKED}) SELECT query_id, query_id % 6 IN (0, 1, 2, 3) AS many FROM a")
def _(spark, sf):
    return asked(spark, sf).select("query_id", Q.should_decompose(F.col("text")).alias("many"))


@query("decompose", """WITH p AS (SELECT *, p_partkey AS q, p_partkey % 6 AS k FROM part)
  SELECT q AS query_id, 0 AS sub_no, CASE k WHEN 0 THEN 'CS ' || (p_size + 100) || ' credits' WHEN 1 THEN p_name || ' prerequisites' WHEN 2 THEN 'prerequisites for ' || p_name WHEN 3 THEN p_name WHEN 4 THEN 'Where is the ' || p_name || ' dining hall, and which bus goes there' ELSE p_name END AS text FROM p
  UNION ALL SELECT q, 1, CASE k WHEN 0 THEN 'MATH ' || (p_size + 200) || ' credits' WHEN 1 THEN p_type || ' prerequisites prerequisites' WHEN 2 THEN 'prerequisites for ' || p_type ELSE p_brand END FROM p WHERE k < 4
  UNION ALL SELECT q, 2, 'prerequisites for ' || p_brand FROM p WHERE k = 2""")
def _(spark, sf):
    return Q.decompose(asked(spark, sf)).select("query_id", "sub_no", "text")


@query("question_parts", """WITH q AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'compare CS ' || (p_size + 100) || ' and MATH 200 credits?' WHEN 1 THEN 'CS ' || (p_size + 100) || ' vs MATH 200?' WHEN 2 THEN 'who teaches CS ' || (p_size + 100) || ' ' || p_name ELSE p_name || ' schedule of CS ' || (p_size + 100) END AS text, p_name FROM part)
  SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'credits' WHEN 1 THEN 'information' WHEN 2 THEN 'who teaches ' || p_name ELSE p_name || ' schedule of' END AS part, CASE query_id % 4 WHEN 0 THEN 'credits' WHEN 1 THEN 'information' WHEN 2 THEN 'instructor' ELSE 'schedule' END AS type FROM q""")
def _(spark, sf):
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('compare CS ', p_size + 100, ' and MATH 200 credits?') WHEN 1 THEN concat('CS ', p_size + 100, ' vs MATH 200?') WHEN 2 THEN concat('who teaches CS ', p_size + 100, ' ', p_name) ELSE concat(p_name, ' schedule of CS ', p_size + 100) END")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), Q.question_part(text).alias("part"), Q.question_type(text).alias("type"))


@query("split_multi_domain", f"WITH a AS ({ASKED}) SELECT query_id, CASE WHEN query_id % 6 = 4 THEN regexp_extract(text, '^(.*), and ', 1) || '|Which bus goes there?' ELSE text END AS parts FROM a")
def _(spark, sf):
    return asked(spark, sf).select("query_id", F.array_join(Q.split_domains(F.col("text"), [(r"\b(dining|food)\b", r"\b(bus|route)\b")]), "|").alias("parts"))


SUBS = """WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS sub_no, l_suppkey AS rank, l_returnflag || l_linestatus AS content, l_returnflag AS source, 'c' || l_suppkey AS context FROM lineitem)"""


@query("merge_sub_results", SUBS + """, n AS (SELECT query_id, count(DISTINCT content) AS n_results FROM r GROUP BY 1), p AS (SELECT query_id, sub_no, min_by(context, rank) AS context FROM r GROUP BY ALL)
  SELECT n.query_id, n_results, c.context, s.sources FROM n JOIN (SELECT query_id, string_agg(context, chr(10) || '---' || chr(10) ORDER BY sub_no) AS context FROM p GROUP BY 1) c USING (query_id)
  JOIN (SELECT query_id, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT query_id, source FROM r) GROUP BY 1) s USING (query_id)""")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber AS sub_no", "l_suppkey AS rank", "concat(l_returnflag, l_linestatus) AS content", "l_returnflag AS source", "concat('c', l_suppkey) AS context")
    return Q.merge_sub_results(rows).select("query_id", "n_results", "context", "sources")


@query("merged_results", """WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS sub_no, l_partkey * 100000 + l_suppkey AS rank, l_returnflag || l_linestatus AS content, l_returnflag AS source FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY sub_no, rank) AS again FROM r)
  SELECT query_id, sub_no, rank, content, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sub_no, rank) AS INT) AS place FROM k WHERE again = 1""")
def _(spark, sf):
    """The results of all sub-questions as one list, the first of equal contents kept."""
    rows = read(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "l_linenumber AS sub_no", "l_partkey * 100000 + l_suppkey AS rank", "concat(l_returnflag, l_linestatus) AS content", "l_returnflag AS source")
    return Q.merged_results(rows)


@query("sub_query_fanout", f"""{TOKENS} s AS (SELECT item_id, generate_subscripts(parts, 1) - 1 AS sub_no, unnest(parts) AS text FROM (SELECT item_id, string_split(text, '. ') AS parts FROM benchmark)),
  q AS (SELECT item_id, sub_no, term, count(*) AS qtf FROM (SELECT item_id, sub_no, unnest({sql_tokens('text')}) AS term FROM s) GROUP BY ALL),
  p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM d), t AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY ALL),
  b AS (SELECT item_id, sub_no, doc_id, round(sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score
        FROM t JOIN f USING (term) CROSS JOIN (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_length FROM d) m JOIN q USING (term) GROUP BY ALL),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, sub_no ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0) WHERE rank <= 5),
  r AS (SELECT item_id AS query_id, sub_no, rank, text, source FROM k JOIN documents USING (doc_id)),
  n AS (SELECT query_id, count(DISTINCT left(text, 100)) AS n_results FROM r WHERE text <> '' GROUP BY 1),
  c AS (SELECT query_id, string_agg(context, chr(10) || '---' || chr(10) ORDER BY sub_no) AS context FROM (SELECT query_id, sub_no, min_by(text, rank) AS context FROM r GROUP BY ALL) GROUP BY 1),
  o AS (SELECT query_id, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT query_id, source FROM r) GROUP BY 1)
  SELECT query_id, n_results, md5(context) AS context, sources FROM n JOIN c USING (query_id) JOIN o USING (query_id)""")
def _(spark, sf):
    """Every sentence of a question is a sub-question; one search answers all of them, and the results are
    merged by question."""
    parts = read(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("sub_no", "text"))
    found = standing(spark, sf).search(parts.select(F.struct("item_id", "sub_no").alias("query_id"), "text"), 5)
    results = found.join(docs(spark, sf).select("doc_id", "text", "source"), "doc_id")
    results = results.select("query_id.item_id", "query_id.sub_no", "rank", F.col("text").alias("content"), "source", F.col("text").alias("context"))
    return Q.merge_sub_results(results.withColumnRenamed("item_id", "query_id")).select("query_id", "n_results", F.md5("context").alias("context"), "sources")
