"""Cleaning and pronouns against Python's own regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from discourse_spark.fixed_values import THEM_PHRASES, THEM_WORDS, WE_WORDS
from discourse_spark.functions import text as X

HOSTILE = [
    "", " ", "PLAIN words", "see http://a.b/c?d=1 now", "www.site.org/x y", "a@Müller b",
    "x y", "x\u0085y\u001cz", "日本語 text", "don't stop -- ever!", "http", "http://a b c",
    "@_under_score @ñandú end", "tab\tnew\nline", "1²3", "ſoft K", "e@mail.com", "a" * 3000 + " @b",
    "wwwxdot www.", "end http://é.example/ü?q", "multi   space", "...,,,!!!???'''---",
]


def python_clean(text):
    if text is None:
        return ""
    text = text.lower()
    text = re.sub(r"(?:http|www\.)\S+", "", text)
    text = re.sub(r"@\w+", "", text)
    text = re.sub(r"[^a-z0-9\s.,!?'\-]", " ", text)
    return " ".join(text.split())


def test_clean_text_equals_python(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()
    texts = HOSTILE + [r[0] for r in documents] + [r[0] for r in pages] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.clean_text("t").alias("c")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == python_clean(text), repr(text)[:200]


def random_texts(seed, n):
    words = WE_WORDS + THEM_WORDS + ["those", "these", "people", "like", "peoples", "use", "house"]
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("mode", ["regex", "lexicon"])
def test_pronoun_counts_equal_python(spark, mode):
    texts = random_texts(1, 400) + ["people like them", "those peoples", "we, us; our's them."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in X.tag_pronouns(df, "t", mode).collect()}
    we = re.compile(r"\b(?:" + "|".join(WE_WORDS) + r")\b")
    words = re.compile(r"\b(?:" + "|".join(THEM_WORDS) + r")\b")
    phrases = "|".join(p.replace(" ", r"\s+") for p in THEM_PHRASES)
    either = re.compile(r"\b(?:" + "|".join(THEM_WORDS) + "|" + phrases + r")\b")
    for i, text in enumerate(texts):
        n_we = len(we.findall(text))
        if mode == "regex":
            n_them = len(either.findall(text))
        else:
            n_them = len(words.findall(text)) + sum(text.count(p) for p in THEM_PHRASES)
        kind = {(1, 1): "both", (1, 0): "we_only", (0, 1): "them_only", (0, 0): "none"}
        row = got[i]
        assert (row.we_count, row.them_count) == (n_we, n_them), text
        assert row.pronoun_type == kind[(int(n_we > 0), int(n_them > 0))]


def test_phrase_counts_differ_between_modes(spark):
    df = spark.createDataFrame([("people like them",), ("those peoples",), (None,)], "t string")
    regex = [r.them_count for r in X.tag_pronouns(df, "t", "regex").collect()]
    lexicon = [r.them_count for r in X.tag_pronouns(df, "t", "lexicon").collect()]
    assert regex == [1, 0, 0]
    assert lexicon == [2, 1, 0]


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        X.them_count(F.lit("x"), "other")


def test_lookups_and_previews(spark):
    df = spark.createDataFrame(
        [("joy", 0.71, "my_tweets.csv", "Twitter  ·  a.csv", "abcdef"),
         ("unheard", 0.7, "fb_posts", "plain.csv", "abc"),
         (None, 0.4, "notes", "G  ·  b.xlsx", None)],
        "emotion string, tox double, file string, dataset string, t string",
    )
    rows = df.select(
        X.emotion_valence(F.col("emotion")), X.toxicity_band(F.col("tox")),
        X.platform_of(F.col("file")), X.dataset_short_name(F.col("dataset")),
        X.truncate_text(F.col("t"), 3, ellipsis=True), X.truncate_text(F.col("t"), 2),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("positive", "high", "twitter", "a", "abc...", "ab"),
        ("neutral", "medium", "facebook", "plain.csv", "abc", "ab"),
        ("neutral", "low", "", "b", None, None),
    ]


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("don't go back a home",), ("one",), ("",)], "t string")
    words = df.select(X.tokens(F.col("t")).alias("w"))
    rows = words.select("w", X.bigrams(F.col("w")).alias("b")).collect()
    assert [(r.w, r.b) for r in rows] == [
        (["don", "go", "back", "home"], ["don go", "go back", "back home"]),
        (["one"], []), ([], []),
    ]


def test_slow_patterns_run_only_where_they_can_match(spark):
    plan = str(X.clean_text("t"))
    assert plan.count("contains") >= 3 and "CASE WHEN" in plan
    texts = ["", "wow", "we WE us, our_ ours-us theirs", "http://x.y/z @me hi", "a@b c", "www. www.x", "@", "http"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", X.clean_text("t").alias("c"), X.we_count(F.col("t")).alias("n")).collect():
        assert row.c == python_clean(row.t)
        assert row.n == len(re.findall(rf"\b(?:{'|'.join(WE_WORDS)})\b", row.t))
