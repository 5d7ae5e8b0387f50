"""Alignment, phrases and urls against brute force, and on messy and empty tables."""

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from discourse_spark.llm import cross_alignment, phrases, url_filter
from discourse_spark.llm.common import table
from discourse_spark.llm.queries import QUERIES, vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    "", None, " ", "   a  b ", "\x00\x01 \t\n", "a▁b", "<|endoftext|> <s> </s> <0x41>", "é" * 60, "日本語 テキスト 👩‍👩‍👧",
    "don't stop; 1234567 x=y", "\n\n\n", "ſtrange İ", "a" * 5000, "long words " * 20_000,
]


def rows(df):
    return [tuple(r) for r in df.collect()]


# alignment


@pytest.fixture(scope="module")
def both():
    return cross_alignment.sides(vocabulary(A), vocabulary(B))


@functools.cache
def plain_tokenizer():
    plain = Tokenizer.from_file(vocabulary(A))
    plain.encode_special_tokens = True
    return plain


def groups_by_force(text, both):
    """[(ids of A, ids of B)] by all common ends."""
    if not text:
        return []
    ids = plain_tokenizer().encode(" " + text, add_special_tokens=False).ids, both[1].model.encode(text)
    parts = [[side.token_bytes[i] for i in own] for side, own in zip(both, ids)]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return []
    ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
    common, groups, at = set(ends[0]) & set(ends[1]), [], [0, 0]
    for end in sorted(common):
        to = [ends[k].index(end, at[k]) + 1 for k in (0, 1)]
        groups.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
        at = to
    return groups


def alignment_by_force(docs, both):
    all_groups = [(i, groups_by_force(t, both)) for i, t in docs]
    counts = Counter((a[-1], b[-1]) for _, groups in all_groups for a, b in groups)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, groups in all_groups:
        name = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        linked = [counts[a[-1], b[-1]] for a, b in groups]
        best = sum(counts[a[-1], b[-1]] == highest[b[-1]] for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(groups), best,
            sum(linked), hashlib.sha256(name.encode()).hexdigest() if name else "",
        ))
    return sorted(out, key=str)


def test_alignment_equals_brute_force(spark, sf_dir, both):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(rows(got), key=str) == alignment_by_force(docs, both)


def test_alignment_of_odd_texts(spark, messy, nothing, both):
    docs = [(i // 2, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (3, ODD[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("x").alias("DOC_ID")).repartition(3)
    got = cross_alignment.align_documents(df, vocabulary(A), vocabulary(B))
    assert sorted(rows(got.documents), key=str) == alignment_by_force(docs, both)
    assert got.documents.agg(F.sum("n_links")).first()[0] == got.pairs.agg(F.sum("n")).first()[0]
    assert messy.count() == cross_alignment.align_documents(messy, vocabulary(A), vocabulary(B)).documents.count()
    empty = cross_alignment.align_documents(nothing, vocabulary(A), vocabulary(B))
    assert empty.documents.count() == empty.pairs.count() == 0


def test_cuts_equal_all_common_ends():
    chance = random.Random(4)
    for size in (1, 2, 3, 10, 400, 20_000):
        for density in (0.02, 0.3, 0.9):
            ends = [sorted({size, *(i for i in range(1, size) if chance.random() < density)}) for _ in "ab"]
            a, b = (np.array(e) for e in ends)
            common = np.array(sorted(set(ends[0]) & set(ends[1])))
            got = cross_alignment.common_cuts(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))
            assert a[got[0]].tolist() == b[got[1]].tolist() == common.tolist()


def test_a_long_interval_without_a_cut():
    n = 30_000
    a, b = np.append(np.arange(1, n, 2), n), np.append(np.arange(2, n, 2), n)
    a_at, b_at = cross_alignment.common_cuts(a, b, np.array([len(a) - 1]), np.array([len(b) - 1]))
    assert a_at.tolist() == [len(a) - 1] and b_at.tolist() == [len(b) - 1]


def test_linked_tokens_are_suffixes(both):
    known = cross_alignment.possible_pairs(*both)
    size = len(both[1].sizes)
    for pair in random.Random(2).sample(known.tolist(), 2_000):
        a, b = both[0].token_bytes[pair // size], both[1].token_bytes[pair % size]
        assert a.endswith(b) or b.endswith(a)
    assert len(known) < 400_000


# phrases


def phrases_by_force(docs, least=30, first=2000):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    frequent = {k: n for k, n in counts.items() if n >= least}
    longer = defaultdict(int)
    for (lang, w), n in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], n)
    by_lang = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2 or 100 * longer[lang, w] >= 80 * a and (lang, w) in longer and longer[lang, w]:
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, totals[lang], -s)
        for lang, own in by_lang.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:first], 1)
    )


def random_texts(n, seed=3):
    chance = random.Random(seed)
    words = ["the", "of", "é", "日", "New", "york", "new", "x-y", "City Hall", "\x1c", "a.b"]
    return [
        (" ".join(chance.choices(words, k=chance.randrange(0, 40))).replace("York", chance.choice(["york", "york!"]))
         + chance.choice(["", "\n", "\t x", "..."]), chance.choice(["en", "en", "de", None, ""]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("share, least, first", [(0.2, 30, 2000), (0.02, 5, 40), (1.0, 12, 2000)])
def test_phrases_equal_brute_force(spark, share, least, first):
    docs = random_texts(400)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string")
    got = phrases.collocations(df.repartition(5), least=least, share=share, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(rows(got)) == phrases_by_force(docs, least, first)


def test_border_failures_are_found_in_further_passes(spark, monkeypatch):
    """Copies that the sample misses hold four frequent words that are frequent nowhere else."""
    passes = []
    counted = phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda *a: passes.append(a) or counted(*a))
    docs = [("only here four words", "en")] * 50
    df = spark.createDataFrame([(7, *d) for d in docs], "doc_id long, text string, lang string").repartition(3)
    got = phrases.collocations(df, share=1e-6)
    assert sorted(rows(got)) == phrases_by_force(docs)
    assert len(passes) == 5  # the sample, the full pass, and one for each longer length
    passes.clear()
    assert sorted(rows(phrases.collocations(df, share=1.0))) == phrases_by_force(docs)
    assert len(passes) == 2


def test_phrases_in_few_bits_and_small_steps(spark, monkeypatch):
    """Collisions in the bitmap and many partial counts change nothing."""
    monkeypatch.setattr(phrases, "BITS", 15)
    monkeypatch.setattr(phrases, "HELD", 50)
    docs = random_texts(300, seed=9)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string")
    assert sorted(rows(phrases.collocations(df, least=8))) == phrases_by_force(docs, 8)


def test_few_border_failures_need_one_further_pass(spark, monkeypatch):
    """Words that the sample misses open longer phrases; those of all lengths are counted at once."""
    passes = []
    counted = phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda *a: passes.append(a) or counted(*a))
    hidden = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 20)) >= 1 << 19
    often = [(i, " ".join(f"w{j}" for j in range(i % 3, 60)), "en") for i in range(200)]
    once = spark.createDataFrame([(i, "only here four words", "en") for i in range(1000, 1300)], "doc_id long, text string, lang string")
    df = spark.createDataFrame(often, once.schema).union(once.where(hidden)).repartition(3)
    docs = [(r["text"], r["lang"]) for r in df.collect()]
    assert sum(text.startswith("only") for text, _ in docs) >= 30
    assert sorted(rows(phrases.collocations(df, share=0.5))) == phrases_by_force(docs)
    assert len(passes) == 3  # the sample, the full pass, and one for all longer lengths


def test_phrases_that_share_a_hash_are_counted_by_words(spark, monkeypatch):
    keys = phrases.Words.keys

    def few(self, hashes):
        for length, own, whole in keys(self, hashes):
            yield length, own & phrases.np.uint64(0xFFF0000000000003), whole

    monkeypatch.setattr(phrases.Words, "keys", few)
    again, spoken = [], phrases._spoken
    monkeypatch.setattr(phrases, "_spoken", lambda *a: again.append(a) or spoken(*a))
    docs = random_texts(300, seed=11)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string")
    assert sorted(rows(phrases.collocations(df, least=8))) == phrases_by_force(docs, 8)
    assert len(again) == 1


def test_few_tasks_send_the_words_of_a_phrase(spark, monkeypatch):
    """400 words that occur 40 times each, once in each of 40 tasks, are not sent by all of these."""
    read, written = [], phrases.written

    def spy(df, name, *a):
        read.append((name, written(df, name, *a)))
        return read[-1][1]

    monkeypatch.setattr(phrases, "written", spy)
    docs = [(40 * i + j, f"w{i}", "en") for j in range(40) for i in range(400)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 40), "doc_id long, text string, lang string")
    got = phrases.frequent_phrases(df)
    assert sorted(rows(got)) == sorted([("en", 0, "", 16000), *(("en", 1, f"w{i}", 40) for i in range(400))])
    assert 400 <= sum(d.where("length > 0").count() for name, d in read if name == "names") < 4000


def test_phrases_of_messy_rows(messy, nothing):
    docs = [(r["text"], r["lang"]) for r in messy.select("text", "lang").collect()]
    assert sorted(rows(phrases.collocations(messy))) == phrases_by_force(docs)
    assert phrases.collocations(nothing).count() == 0


# urls

URLS = [
    "http://a.com/x", "https://www.example.com/en/1?a=1&b=2#c", "https://example.com/en", "https://EXAMPLE.com/en/",
    "https://m.www.example.com/en/7.html", "https://xexample.com/en/", "ftp://b.net/es/", "http://b.net/fr", None, "",
    "no scheme", "http://", "://h/p", "http://x.org?q=://y.com/", "http://c.com#f", "http://c.com:80/", "http://é.net/fr/é",
    "http://a.net//es/", "http://com/", "http://.com/", "http://b.NET/fr/?u", "http://" + "l" * 50_000 + ".org/" + "9" * 50_000,
]


def url_by_force(url):
    host = path = ""
    rest = (url or "").partition("://")
    if rest[1]:
        host = re.match(r"[^/?#]*", rest[2]).group()
        path = re.match(r"[^?#]*", rest[2][len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, rule in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best


def test_rules_equal_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in table(spark, sf_dir, "pages").collect()]
    df = spark.createDataFrame(pages + [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0])] * 2,
                               "page_id long, url string").select("*", F.lit("x").alias("URL"), F.lit(3).alias("label"))
    wanted = Counter()
    for page_id, url in [*pages, *enumerate(URLS), *[(None, URLS[0])] * 2]:
        host, path, best = url_by_force(url)
        wanted[page_id, host, path, best and best[0], best and best[1]] += 1
    got = Counter()
    for page_id, host, path, rule, verdict, score in rows(url_filter.judge(df)):
        assert verdict in ("allow", "block") and (rule is None) == (score is not None)
        assert score is None or (score >= 0.5) == (verdict == "block")
        got[page_id, host, path, rule, verdict if rule else None] += 1
    assert got == wanted


def test_registered_urls(spark, sf_dir):
    got = QUERIES["op13_url_filter"](spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "pages").count()
    assert {"page_id", "host", "path", "rule", "verdict"} <= set(got.columns)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lexical_features(spark):
    urls = ["http://ab.c1.com/x/y.html?a=1&&b=22#z?w", "", None, "http://aaaa"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumns(
        {"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))}
    )
    for row in url_filter.with_features(df).collect():
        text = row["url"] or ""
        n = Counter(text)
        entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in n.values()) if text else 0.0
        assert row["url_entropy"] == pytest.approx(entropy) and row["url_length"] == len(text)
    first = url_filter.with_features(df).where("path <> ''").first()
    assert (first["path_depth"], first["host_depth"], first["parameters"], first["parameter_length"]) == (2, 3, 2, 9)
    assert (first["top"], first["site"], first["ending"]) == ("com", "c1.com", "html")
    assert first["host_digits"] == pytest.approx(1 / 9)


def test_trees_learn_labelled_urls(spark):
    """Blocked urls have many parameters and digits; a third of all rows is one url."""
    chance = random.Random(5)
    made = [("".join(chance.choices("abcdef", k=8)), chance.random() < 0.5, chance.randrange(3)) for _ in range(900)]
    urls = [
        (f"http://{w}{chance.randrange(10**6) if bad else ''}.org/{w}" + ("?" + "&".join(f"p{i}={i}" for i in range(6)) if bad else ""), int(bad))
        for w, bad, _ in made
    ] + [("http://hot.org/a", 0)] * 450
    df = spark.createDataFrame(urls, "url string, label int").withColumns(
        {"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))}
    )
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    model = url_filter.fit(df.where(~held), rules=())
    scored = url_filter.judge(df.where(held).withColumn("page_id", F.col("label")), model)
    wrong = scored.where((F.col("page_id") == 1) != (F.col("verdict") == "block")).count()
    assert wrong <= 0.03 * scored.count()
    small = url_filter.fit(df.where(~held), rules=(), sample=100)
    assert small.statistics.count() < model.statistics.count()


def test_urls_without_labels(spark, nothing):
    schema = "page_id long, url string"
    empty = spark.createDataFrame([], schema)
    assert url_filter.judge(empty).count() == 0 and url_filter.keep_allowed(empty).columns == empty.columns
    one = spark.createDataFrame([(1, "http://a.net/es/"), (2, "http://a.org/")], schema)
    assert sorted(rows(url_filter.judge(one).select("page_id", "verdict"))) == [(1, "block"), (2, "block")]
    none = spark.createDataFrame([(2, "http://a.org/")], schema)
    assert rows(url_filter.judge(none).select("verdict")) == [("allow",)]


def test_allowed_rows_stay_as_they_are(spark):
    df = spark.createDataFrame(
        [(1, "http://a.net/es/", "x", "y"), (2, "http://a.com/", "x", None), (2, "http://a.com/", "x", None)],
        "page_id long, url string, host string, ROW string",
    )
    got = url_filter.keep_allowed(df)
    assert got.columns == df.columns and rows(got) == [(2, "http://a.com/", "x", None)] * 2


def test_every_labelled_suffix_counts(spark):
    """More different labelled urls than an earlier sample held: each has a suffix of its own, all counted."""
    n = 21_000
    df = spark.range(n).select(
        F.concat(F.lit("http://a."), F.col("id").cast("string"), F.lit(".org/")).alias("url"),
        (F.col("id") % 2).cast("int").alias("label"),
    ).withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    found = url_filter.fit(df, rules=()).statistics
    assert found.where("kind = 'site'").agg(F.count("*"), F.sum("n"), F.sum("blocked")).first()[:] == (n, n, n // 2)


def test_counting_hashes_keeps_one_copy_of_them():
    parts = [np.array([3, 1, 3], dtype=np.uint64), np.array([1, 3, 1 << 63], dtype=np.uint64)]
    keys, n = phrases._tally(parts)
    assert parts == [] and keys.tolist() == [1, 3, 1 << 63] and n.tolist() == [2, 3, 1]
    assert [len(x) for x in phrases._tally([np.zeros(0, dtype=np.uint64)])] == [0, 0]
