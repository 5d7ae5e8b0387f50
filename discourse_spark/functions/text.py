"""Text expressions: cleaning, pronoun tags, previews, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discourse_spark.fixed_values import (
    DATASET_SEPARATOR,
    EMOTION_VALENCE,
    THEM_PHRASES,
    THEM_WORDS,
    TOXICITY_BANDS,
    WE_WORDS,
)

# Unicode-aware stand-ins for \S and \w, which are ASCII-only in Java.
_NON_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]+"
_URL = rf"http{_NON_SPACE}|www\.{_NON_SPACE}"
_MENTION = r"@[\p{L}\p{N}_]+"
# Runs of anything outside the kept alphabet become one space, which covers both
# "replace other characters" and "collapse whitespace". Digits are spelled out
# because one range plus single characters is several times faster in Java than
# a class made of two ranges.
_OTHER_RUN = r"[^a-z0123456789.,!?'\-]+"


def clean_text(text: Column | str) -> Column:
    """Lowercase, drop URLs and mentions, keep ``a-z0-9.,!?'-`` and single spaces.

    Byte searches spare texts without an address or an ``@`` the slower patterns. The lowered
    text is the variable of a function, so that the plan names it once.
    """
    lowered = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.transform(F.array(lowered), _kept)[0]


def _kept(lowered: Column) -> Column:
    may_link = lowered.contains("http") | lowered.contains("www.")
    without_urls = F.when(may_link, F.regexp_replace(lowered, _URL, "")).otherwise(lowered)
    without_mentions = F.when(
        without_urls.contains("@"), F.regexp_replace(without_urls, _MENTION, "")
    ).otherwise(without_urls)
    return F.trim(F.regexp_replace(without_mentions, _OTHER_RUN, " "))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _substring_hits(text: Column, phrase: str) -> Column:
    removed = F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return F.when(text.contains(phrase), (removed / len(phrase)).cast("int")).otherwise(0)


def _whole(words: list[str]) -> str:
    """A pattern of whole words; most characters fail its first test, which is cheaper than ``\\b``."""
    letters = "".join(sorted({word[0] for word in words}))
    return rf"(?=[{letters}])\b({'|'.join(words)})\b"


def we_count(text: Column) -> Column:
    return _count(text, _whole(WE_WORDS))


def them_count(text: Column, mode: str) -> Column:
    """Out-group markers.

    ``regex`` counts words and phrases in one alternation, so "people like them"
    is one hit. ``lexicon`` adds word hits and plain substring hits of the
    phrases, so the same text counts two.
    """
    if mode == "regex":
        phrases = [p.replace(" ", r"\s+") for p in THEM_PHRASES]
        return _count(text, _whole(THEM_WORDS + phrases))
    if mode != "lexicon":
        raise ValueError(f"unknown pronoun mode {mode!r}")
    hits = _count(text, _whole(THEM_WORDS))
    for phrase in THEM_PHRASES:
        hits = hits + _substring_hits(text, phrase)
    return hits


def pronoun_type(we: Column, them: Column) -> Column:
    return (
        F.when((we > 0) & (them > 0), "both")
        .when(we > 0, "we_only")
        .when(them > 0, "them_only")
        .otherwise("none")
    )


def tag_pronouns(df: DataFrame, text_col: str = "clean_text", mode: str = "regex") -> DataFrame:
    """Add has_we, has_them, we_count, them_count and pronoun_type."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counted = df.withColumns({"we_count": we_count(text), "them_count": them_count(text, mode)})
    we, them = F.col("we_count"), F.col("them_count")
    return counted.withColumns(
        {"has_we": we > 0, "has_them": them > 0, "pronoun_type": pronoun_type(we, them)}
    )


def emotion_valence(label: Column) -> Column:
    """positive / negative / neutral; unknown labels are neutral."""
    lookup = F.create_map(*[F.lit(x) for pair in EMOTION_VALENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, label), F.lit("neutral"))


def toxicity_band(score: Column) -> Column:
    high, medium = TOXICITY_BANDS
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def platform_of(file_name: Column) -> Column:
    """Guess the platform from a file name; empty when nothing fits."""
    name = F.lower(file_name)

    def has(*parts: str) -> Column:
        hit = name.contains(parts[0])
        for part in parts[1:]:
            hit = hit | name.contains(part)
        return hit

    return (
        F.when(has("tiktok"), "tiktok")
        .when(has("twitter", "tweet", "_x_"), "twitter")
        .when(has("instagram", "insta"), "instagram")
        .when(has("reddit"), "reddit")
        .when(has("youtube"), "youtube")
        .when(has("facebook", "fb_"), "facebook")
        .otherwise("")
    )


def dataset_short_name(dataset: Column) -> Column:
    """``Group  ·  file.csv`` becomes ``file``; labels without a group stay."""
    last = F.element_at(F.split(dataset, DATASET_SEPARATOR), -1)
    return F.when(
        dataset.contains(DATASET_SEPARATOR), F.regexp_replace(last, r"\.(csv|xlsx)$", "")
    ).otherwise(dataset)


def truncate_text(text: Column, n: int, ellipsis: bool = False) -> Column:
    """First ``n`` characters for display, with "..." when asked and cut."""
    head = F.substring(text, 1, n)
    if not ellipsis:
        return head
    return F.when(F.length(text) > n, F.concat(head, F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Word runs of two or more characters of a cleaned text."""
    return F.regexp_extract_all(text, F.lit("[a-z0-9_]{2,}"), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank; ``words`` should be a plain column."""
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_compact(
        F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b))
    )
