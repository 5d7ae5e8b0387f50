"""Every rule with a hit and a near miss; labels and scores against Python's ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from discourse_spark.fixed_values import RULES
from discourse_spark.functions import rules as R

# label -> (text that must match, text that must not)
VECTORS = {
    "invasion": ("they invade us", "invaders come"),
    "flood": ("flooding in", "floods of light"),
    "swarm": ("a swarming crowd", "swarms of bees"),
    "infestation": ("an infested town", "infests it"),
    "plague": ("plagues us", "a plaguey day"),
    "vermin": ("like rats", "a rattle"),
    "animals": ("savages", "beastly"),
    "parasite": ("parasitic", "parasitism"),
    "dont_belong": ("you dont belong", "do not belong"),
    "go_back": ("go back to your place", "go back to a place"),
    "not_like_us": ("not like us", "not likes us"),
    "their_kind": ("their kind", "their kindness"),
    "not_welcome": ("not welcome here", "not welcome there"),
    "get_out": ("leave our land", "leave our house"),
    "no_place_here": ("no place in this country", "no place in that country"),
    "send_them_back": ("send them back", "send them backwards"),
    "all_of_them": ("all of them", "all of the men"),
    "these_ppl_always": ("these people always", "these people never"),
    "they_never": ("they never", "they nevertheless"),
    "they_all": ("they're all", "they all"),
    "all_they_do": ("all they care", "all they cared"),
    "every_single_one": ("every single one of them", "every single one of us"),
    "those_people": ("those kind of people", "those peoples"),
    "none_of_them": ("none of them", "none of the men"),
    "taking_over": ("taking over", "taking overs"),
    "replacing_us": ("replacing us", "replacing usage"),
    "replacement": ("great replacement", "replacements"),
    "destroying_our": ("destroying our home", "destroy our home"),
    "under_attack": ("being attacked", "being attack"),
    "erase_us": ("erasing us", "erases us"),
    "our_culture": ("threaten our way of life", "threaten our way"),
    "white_genocide": ("demographic replacement", "demographic change"),
}


def python_labels(text):
    return [label for rules in RULES.values() for label, pattern in rules.items()
            if re.search(pattern, text, re.IGNORECASE)]


def labels_of(spark, texts, cleaned=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r for r in R.apply_othering(df, "t", cleaned).collect()}


def test_every_rule_has_vectors():
    assert list(VECTORS) == R.LABELS and len(R.LABELS) == 32
    assert set(R.FRAGMENTS) == set(R.LABELS)


@pytest.mark.parametrize("cleaned", [True, False])
def test_hits_and_near_misses(spark, cleaned):
    hits = labels_of(spark, [VECTORS[x][0] for x in R.LABELS], cleaned)
    misses = labels_of(spark, [VECTORS[x][1] for x in R.LABELS], cleaned)
    for i, label in enumerate(R.LABELS):
        assert label in hits[i].matched_patterns, label
        assert label not in misses[i].matched_patterns, label


def test_random_sentences_equal_python(spark):
    """Words of all rules in random order: the fragment test never hides a match."""
    words = sorted({w for pair in VECTORS.values() for t in pair for w in t.split()})
    rng = random.Random(7)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(1500)]
    texts += [a + " " + b for a, _ in VECTORS.values() for b, _ in VECTORS.values()]
    got = labels_of(spark, texts)
    for i, text in enumerate(texts):
        want = python_labels(text)
        assert got[i].matched_patterns == want, text
        families = {R.FAMILY_OF[label] for label in want}
        assert got[i].othering_score == len(families) <= 4
        assert got[i].has_othering == bool(want)


def test_overlapping_rules_count_one_family(spark):
    row = labels_of(spark, ["destroying our culture"])[0]
    assert row.matched_patterns == ["destroying_our", "our_culture"] and row.othering_score == 1


def test_raw_text_ignores_case_in_unicode(spark):
    rows = labels_of(spark, ["THEY NEVER", "they neſver", "Great Replacement", None], False)
    assert [rows[i].has_othering for i in range(4)] == [True, False, True, False]


def test_all_labels_occur_in_the_corpus(facts):
    from pyspark.sql import functions as F

    found = facts.select(F.explode("matched_patterns").alias("p")).distinct().collect()
    assert {r.p for r in found} == set(R.LABELS)


def test_only_rules_of_open_families_are_tried(spark, monkeypatch):
    """Each hit opens its family alone, a near miss none; odd blanks and letters hide no match."""
    texts = [VECTORS[label][0] for label in R.LABELS] + [VECTORS[label][1] for label in R.LABELS] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    opened = {r.i: r.o.asDict() for r in df.select("i", R.open_families(df.t).alias("o")).collect()}
    for i, text in enumerate(texts):
        want = {R.FAMILY_OF[label] for label in python_labels(text or "")}
        assert {family for family, is_open in opened[i].items() if is_open} == want, text

    odd = ["they\x0bnever", "they\u00a0never", "\u00e9they never", "they never\u00e9", "rat\u0301", "\u200brats\n", "no\tplace\r\nhere",
           "_rats", "rats_", "7rats", "\U0001f400rats\U0001f400", "", "they \x1c never", "don'\u2019t belong"]
    got = labels_of(spark, odd)
    native = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    for row in native.select("i", R.match_patterns(native.t).alias("m")).collect():
        assert got[row.i].matched_patterns == row.m, odd[row.i]
    assert any(got[i].has_othering for i in range(len(odd)))

    # with all families closed no rule is tried
    monkeypatch.setattr(R, "open_families", lambda text: F.struct(*[F.lit(False).alias(f) for f in R.FAMILIES]))
    assert not any(r.has_othering for r in labels_of(spark, texts).values())
