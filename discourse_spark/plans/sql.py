"""Common table expressions for the SQL counterparts, in DuckDB's dialect."""

from __future__ import annotations

from discourse_spark.fixed_values import EMOTION_VALENCE, RULES, THEM_PHRASES, THEM_WORDS, WE_WORDS
from discourse_spark.plans.corpus import CALENDAR, PHRASE_SLOTS, PHRASES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


_NON_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]+"


def clean(text: str) -> str:
    steps = [
        (rf"http{_NON_SPACE}|www\.{_NON_SPACE}", ""), (r"@[\p{L}\p{N}_]+", ""),
        (r"[^a-z0-9\s.,!?'\-]", " "), (r"\s+", " "),
    ]
    result = f"lower(coalesce({text}, ''))"
    for pattern, replacement in steps:
        result = f"regexp_replace({result}, {quoted(pattern)}, '{replacement}', 'g')"
    return f"trim({result})"


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def lexicon_them(text: str) -> str:
    words = hits(text, rf"\b({'|'.join(THEM_WORDS)})\b")
    phrases = [
        f"(length({text}) - length(replace({text}, '{p}', ''))) // {len(p)}" for p in THEM_PHRASES
    ]
    return " + ".join([words, *phrases])


def regex_them(text: str) -> str:
    phrases = [p.replace(" ", r"\s+") for p in THEM_PHRASES]
    return hits(text, rf"\b({'|'.join(THEM_WORDS + phrases)})\b")


def we(text: str) -> str:
    return hits(text, rf"\b({'|'.join(WE_WORDS)})\b")


PRONOUN_TYPE = (
    "CASE WHEN we_count > 0 AND them_count > 0 THEN 'both' WHEN we_count > 0 THEN 'we_only' "
    "WHEN them_count > 0 THEN 'them_only' ELSE 'none' END"
)


def family_of(label: str) -> str:
    cases = [
        f"WHEN {label} IN {in_list(rules)} THEN '{family}'" for family, rules in RULES.items()
    ]
    return f"CASE {' '.join(cases)} END"


def valence_of(label: str) -> str:
    by_valence = {}
    for emotion, valence in EMOTION_VALENCE.items():
        by_valence.setdefault(valence, []).append(emotion)
    cases = [f"WHEN {label} IN {in_list(e)} THEN '{v}'" for v, e in by_valence.items()]
    return f"CASE {' '.join(cases)} ELSE 'neutral' END"


def short(dataset: str) -> str:
    return f"regexp_replace(split_part({dataset}, '  ·  ', 2), '\\.(csv|xlsx)$', '')"


_PHRASE_ROWS = ", ".join(f"({k}, {quoted(p)})" for k, p in enumerate(PHRASES))

POSTS = f"""posts AS (
SELECT doc_id AS post_id, text || coalesce(' ' || phrase, '') AS text,
  CASE WHEN doc_id % 7 < 3 THEN 'reddit' ELSE 'hate_speech' END AS source,
  CASE doc_id % 7 WHEN 0 THEN 'politics' WHEN 1 THEN 'europe' WHEN 2 THEN 'worldnews' END AS subreddit,
  CASE doc_id % 4 WHEN 0 THEN 'Twitter  ·  tw_a.csv' WHEN 1 THEN 'Tiktok  ·  tk_b.csv'
    WHEN 2 THEN 'Instagram  ·  ig_c.csv' ELSE 'Default  ·  dataset_final.csv' END AS dataset,
  DATE '2024-01-01' + CAST(doc_id % 97 AS INT) AS post_date,
  CASE WHEN doc_id % 11 = 0 THEN 0
    ELSE epoch(DATE '2024-01-01' + CAST(doc_id % 97 AS INT))::BIGINT + doc_id % 86400 END AS created_utc,
  CASE WHEN doc_id % 5 <> 0 THEN CAST((doc_id * 37) % 101 AS DOUBLE) / 100 END AS toxicity,
  CASE doc_id % 9 WHEN 0 THEN 'neutral' WHEN 1 THEN 'anger' WHEN 2 THEN 'joy' WHEN 3 THEN 'neutral'
    WHEN 4 THEN 'fear' WHEN 5 THEN 'annoyance' WHEN 6 THEN 'curiosity' WHEN 7 THEN 'anger' END AS emotion,
  CAST(doc_id % 13 - 1 AS BIGINT) AS topic,
  CASE WHEN doc_id % 13 = 0 THEN 'outlier' ELSE 'topic_' || (doc_id % 13 - 1) END AS topic_name
FROM documents LEFT JOIN (VALUES {_PHRASE_ROWS}) AS m(k, phrase) ON k = doc_id % {PHRASE_SLOTS})"""

CLEAN = f"""clean AS MATERIALIZED (SELECT *, {clean('text')} AS clean_text FROM posts)"""

_MATCHES = ", ".join(
    f"CASE WHEN regexp_matches(clean_text, {quoted(p)}) THEN '{label}' END"
    for rules in RULES.values() for label, p in rules.items()
)
_SCORE = " + ".join(
    f"list_has_any(matched, [{', '.join(quoted(x) for x in rules)}])::INT"
    for rules in RULES.values()
)

FACTS = f"""tagged AS (
SELECT *, {we('clean_text')} AS we_count, {lexicon_them('clean_text')} AS them_count,
  [x FOR x IN [{_MATCHES}] IF x IS NOT NULL] AS matched FROM clean),
facts AS MATERIALIZED (
SELECT * REPLACE (coalesce(subreddit, 'unknown') AS subreddit), we_count > 0 AS has_we,
  them_count > 0 AS has_them, {PRONOUN_TYPE} AS pronoun_type,
  CAST({_SCORE} AS BIGINT) AS othering_score, len(matched) > 0 AS has_othering,
  CAST(len(matched) > 0 AS BIGINT) AS othering_predicted FROM tagged)"""

CALENDAR_CTE = (
    "calendar AS (SELECT CAST(date AS DATE) AS date, title, category, country FROM (VALUES "
    + ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in CALENDAR)
    + ") AS e(date, title, category, country))"
)


def _tail(body: str) -> str:
    body = body.strip()
    return " " + body if body.upper().startswith("SELECT") else ", " + body


def with_posts(body: str) -> str:
    return f"WITH {POSTS}{_tail(body)}"


def with_clean(body: str) -> str:
    return f"WITH {POSTS}, {CLEAN}{_tail(body)}"


def with_facts(body: str) -> str:
    return f"WITH {POSTS}, {CLEAN}, {FACTS}, {CALENDAR_CTE}{_tail(body)}"
