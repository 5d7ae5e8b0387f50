"""Frequent phrases and how firmly their words stick together, by sampling and a checked border.

A phrase is two to four neighbouring words of a piece, the text between two marks of
punctuation or line ends; all counts are per language. A phrase can't be more frequent than
its first or its last part, so a phrase is worth counting only if both parts of it that lack
one word are frequent themselves.

1. A sample of the documents (``SHARE`` of them, by a hash of the row) is counted whole. What is
   frequent there, by a lowered bound, is what the sample proposes.
2. A full pass counts over all documents every word, the proposed phrases, and their negative
   border: all phrases that were not proposed although both of their parts were. As long as
   nothing of the border turns out to be frequent, no other phrase can be.
3. Else the frequent ones of the border join the proposed ones. That opens phrases whose parts
   are both known only now. If these are few, one further pass counts them together with all
   longer ones that they could open. Else a pass counts just those, and so on until a pass finds
   none. Each pass settles at least one more length, so there are at most four.
4. The words of the frequent phrases are read from a part of the documents (``NAMED`` of them),
   those of phrases that do not occur there from the rest. A task sends a phrase once, and few
   tasks hold one of a middling count, so that these rows grow with the number of phrases.

Passes know phrases by 64-bit hashes (62 bits and the length). Which are known is kept in a
bitmap of ``BITS`` bits whatever the corpus; it is the only thing that is sent to all tasks. A
collision there only makes a pass count more than it has to. For collisions among hashes a
second hash of 31 bits is summed over the occurrences: it must come to that of the words that
were read, times the count. Where it does not, different phrases share a hash, and a further
pass counts these by words, and within a task by 128 bits. Each task counts its own documents
first, a few million phrases at a time, so that very common ones cost no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import freed, id_or_last, pick, ship, text_batches, written
from discourse_spark.llm.words import BASE, LOWER, mix, span_hashes, words_of
from discourse_spark.operators.ranks import with_running_total

LEAST = 30  # occurrences of a phrase in a language
LONGEST = 4  # words
SHARE = 0.2  # of the documents are the sample
NAMED = 0.125  # of the documents are read for words first
LOWERED = 0.5  # of what LEAST comes to in the sample makes a proposal there, two at least
BITS = 27  # the bitmap of known phrases has 2 ** BITS bits, 16 MB
CHECK = (1 << 31) - 1  # a prime; sums of second hashes are kept modulo this
HELD = 2_000_000  # hashes that a task collects before it counts them
MOST_SPOKEN = 1_000_000  # phrases whose words a task collects before it sends them on
ROWS = 1 << 16  # sent on at once
FEW = 10  # a tenth of the words, or of the proposed phrases
COVERED = (100, 80)  # a longer phrase covers one if 100 * f(longer) >= 80 * f(shorter)
FIRST = 2_000  # phrases reported per language
NO_LANGUAGE = "und"

# fixed values: the bytes between pieces, and those between words of a piece
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b" \t"

_MARK = np.zeros(256, dtype=bool)
_MARK[list(MARKS)] = True
_BREAK = _MARK.copy()
_BREAK[list(SPACES)] = True
_SECOND = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)


class Words:
    """The words of some texts: hashes, places, and the pieces they belong to."""

    def __init__(self, texts: list[bytes], salts: np.ndarray):
        self.hashes, bounds, self.buffer, self.starts, self.ends = words_of(texts, _BREAK)
        self.text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.salts = salts[self.text]
        marks = np.cumsum(np.append(np.uint32(0), _MARK[self.buffer].astype(np.uint32)))
        new = np.ones(len(self.hashes), dtype=bool)
        if len(new):
            new[1:] = marks[self.starts[1:]] > marks[self.ends[:-1]]
        self.piece = np.cumsum(new)  # texts are joined by a line feed, a mark
        self.seconds: np.ndarray | None = None

    def second_hashes(self) -> np.ndarray:
        return span_hashes(self.buffer, self.starts, self.ends, _SECOND)

    def keys(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, key at each word, whether as many words are left in the piece)."""
        n = len(hashes)
        chain = hashes.copy()
        for length in range(1, LONGEST + 1):
            left = max(n - length + 1, 0)
            if length > 1:
                chain = chain[:left] * np.uint64(BASE) + hashes[length - 1 :]
            keys = mix(chain ^ self.salts[:left] ^ np.uint64(length * 0x1F3D5B79A2C4E681))
            keys = keys & ~np.uint64(3) | np.uint64(length - 1)
            yield length, keys, self.piece[length - 1 :] == self.piece[:left]

    def checks(self, length: int, at: np.ndarray) -> np.ndarray:
        """31 bits of the second hashes of the phrases that begin at some words."""
        if self.seconds is None and len(at) * length * FEW < len(self.hashes):
            used = np.unique(np.concatenate([at + k for k in range(length)]))
            sizes = self.ends[used] - self.starts[used]
            until = np.cumsum(sizes)
            begin = until - sizes
            own = self.buffer[np.repeat(self.starts[used] - begin, sizes) + np.arange(sizes.sum())]
            seconds = span_hashes(own, begin, until, _SECOND)
        else:
            if self.seconds is None:
                self.seconds = self.second_hashes()
            used, seconds = None, self.seconds

        def of(at: np.ndarray) -> np.ndarray:
            return seconds[at if used is None else np.searchsorted(used, at)]

        chain = of(at)
        for k in range(1, length):
            chain = chain * np.uint64(BASE) + of(at + k)
        return (mix(chain ^ self.salts[at]) >> np.uint64(33)).astype(np.uint32)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _read(part: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    langs = part.column(1).to_pylist()
    for first, last, texts in text_batches(part.column(0)):
        salts = np.array([_salt(lang) for lang in langs[first:last]], dtype=np.uint64)
        yield Words([t.translate(LOWER) for t in texts], salts), langs[first:last]


class Bitmap:
    """Which keys are known; more may seem to be."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - BITS)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of the keys of a table. Built by tasks in ranges of 32 768 bits, of which there are 2 ** BITS / 32 768 at most."""
    place = F.shiftrightunsigned("key", 64 - BITS) + 1
    ranges = keys.select(
        F.bitmap_bucket_number(place).alias("range"), F.bitmap_bit_position(place).alias("bit")
    )
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ranges.repartition(n, "range").groupBy("range").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    size = (1 << BITS) // 8
    bits = np.zeros(size, dtype=np.uint8)
    for i, own in zip(parts["range"].to_pylist(), parts["bits"]):
        at = (i - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(own.as_buffer(), dtype=np.uint8)[: size - at]
    return bits


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _checked_tally(parts: list[np.ndarray], checks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, held = np.concatenate(parts), np.concatenate(checks)
    parts.clear()
    checks.clear()
    order = np.argsort(keys)
    keys, held = keys[order], held[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(held, first, dtype=np.int64) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys))), sums % CHECK


def _rows(keys: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), ROWS):
        columns = [keys[at : at + ROWS].view(np.int64), *(n[at : at + ROWS] for n in counts)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "c"][: len(columns)])


def _counted(now, before, every_word: bool, ahead: bool = False):
    """Counts of the phrases whose parts are all in ``now`` but not all in ``before``, and the sums
    of their second hashes; counts alone of all phrases where ``now`` is None. With ``ahead``
    a phrase that is counted here may be a part as well."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if now is None else Bitmap(now.value)
        earlier = None if before is None else Bitmap(before.value)
        held, checks, size = [], [], 0

        def tally():
            return _tally(held) if known is None else _checked_tally(held, checks)

        for part in parts:
            for words, _ in _read(part):
                own = old = None
                for length, keys, whole in words.keys(words.hashes):
                    if own is None:
                        wanted = whole if every_word or known is None else np.zeros(len(keys), dtype=bool)
                    elif known is None:
                        wanted = whole
                    else:
                        wanted = whole & own[:-1] & own[1:]
                        if earlier is not None:
                            wanted &= ~(old[:-1] & old[1:])
                    if known is not None and length < LONGEST:
                        own = known.has(keys)
                        old = None if earlier is None else earlier.has(keys)
                        if ahead:
                            own |= wanted
                    else:
                        own = keys
                    at = np.flatnonzero(wanted)
                    held.append(keys[at])
                    if known is not None:
                        checks.append(words.checks(length, at))
                    size += len(at)
                if size > HELD:
                    size = 0
                    yield from _rows(*tally())
        if held:
            yield from _rows(*tally())

    return counted


class Spoken:
    """Counts of phrases by 128 bits, and their words, in a task."""

    def __init__(self):
        self.keys = self.others = np.zeros(0, dtype=np.uint64)  # in order of the keys
        self.n = self.place = np.zeros(0, dtype=np.int64)
        self.langs: list[str] = []
        self.lengths: list[int] = []
        self.phrases: list[bytes] = []

    def add(self, words: Words, langs: list[str], length: int, at: np.ndarray, keys: np.ndarray,
            others: np.ndarray) -> None:
        order = at[np.lexsort((others[at], keys[at]))]
        if not len(order):
            return
        new = np.append(True, (np.diff(keys[order]) != 0) | (np.diff(others[order]) != 0))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        at = order[first]
        keys, others = keys[at], others[at]
        where = np.searchsorted(self.keys, keys)
        there = np.flatnonzero(where < len(self.keys))
        there = there[(self.keys[where[there]] == keys[there]) & (self.others[where[there]] == others[there])]
        np.add.at(self.n, where[there], n[there])
        fresh = np.ones(len(keys), dtype=bool)
        fresh[there] = False
        self.keys = np.insert(self.keys, where[fresh], keys[fresh])
        self.others = np.insert(self.others, where[fresh], others[fresh])
        self.n = np.insert(self.n, where[fresh], n[fresh])
        self.place = np.insert(self.place, where[fresh], len(self.phrases) + np.arange(fresh.sum()))
        starts, ends, text = words.starts, words.ends, words.buffer
        for i in at[fresh].tolist():
            own = b" ".join(text[starts[j] : ends[j]].tobytes() for j in range(i, i + length))
            self.langs.append(langs[words.text[i]])
            self.lengths.append(length)
            self.phrases.append(own)

    def rows(self) -> Iterator[pa.RecordBatch]:
        n, keys = np.zeros(len(self.phrases), dtype=np.int64), np.zeros(len(self.phrases), dtype=np.uint64)
        n[self.place], keys[self.place] = self.n, self.keys
        yield from _spoken_rows(keys, self.langs, self.lengths, self.phrases, n)


def _spoken_rows(keys: np.ndarray, langs: list, lengths: list, phrases: list[bytes],
                 n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(phrases), ROWS):
        own = slice(first, first + ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[own].view(np.int64)), pa.array(langs[own], pa.string()), pa.array(lengths[own], pa.int32()),
             pa.array([p.decode("utf-8", "replace") for p in phrases[own]], pa.string()), pa.array(n[own], pa.int64())],
            names=["key", "lang", "length", "phrase", "n"],
        )


SPOKEN = "key long, lang string, length int, phrase string, n long"


class Names:
    """The words of some phrases, each once, in a task, with second hashes."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.uint64)  # in order
        self.sent: list[np.ndarray] = []  # keys, in the order of the phrases
        self.checks: list[np.ndarray] = []
        self.langs: list[str] = []
        self.lengths: list[int] = []
        self.phrases: list[bytes] = []

    def add(self, words: Words, langs: list[str], length: int, at: np.ndarray, keys: np.ndarray) -> None:
        own, first = np.unique(keys[at], return_index=True)
        where = np.searchsorted(self.keys, own)
        there = np.flatnonzero(where < len(self.keys))
        fresh = np.ones(len(own), dtype=bool)
        fresh[there[self.keys[where[there]] == own[there]]] = False
        at = at[first[fresh]]
        if not len(at):
            return
        self.keys = np.insert(self.keys, where[fresh], own[fresh])
        self.sent.append(own[fresh])
        self.checks.append(words.checks(length, at).astype(np.int64))
        starts, ends, text = words.starts, words.ends, words.buffer
        for i in at.tolist():
            self.langs.append(langs[words.text[i]])
            self.lengths.append(length)
            self.phrases.append(b" ".join(text[starts[j] : ends[j]].tobytes() for j in range(i, i + length)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.sent:
            yield from _spoken_rows(
                np.concatenate(self.sent), self.langs, self.lengths, self.phrases, np.concatenate(self.checks)
            )


def _named(known):
    """(key, lang, length, phrase, second hash) of the known phrases, one of each key, and the
    number of words of each language under length 0."""

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(known.value)
        names, totals = Names(), {}
        for part in parts:
            for words, langs in _read(part):
                for text, n in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
                    totals[langs[text]] = totals.get(langs[text], 0) + n
                for length, keys, whole in words.keys(words.hashes):
                    names.add(words, langs, length, np.flatnonzero(whole & bits.has(keys)), keys)
                if len(names.phrases) > MOST_SPOKEN:
                    yield from names.rows()
                    names = Names()
        yield from names.rows()
        yield from _spoken_rows(
            np.zeros(len(totals), dtype=np.uint64), list(totals), [0] * len(totals), [b""] * len(totals),
            np.array(list(totals.values()), dtype=np.int64),
        )

    return named


def _spoken(known):
    """(key, lang, length, phrase, n) of the known phrases, counted by words."""

    def spoken(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(known.value)
        counts = Spoken()
        for part in parts:
            for words, langs in _read(part):
                seconds = words.keys(words.second_hashes())
                for (length, keys, whole), (_, others, _) in zip(words.keys(words.hashes), seconds):
                    counts.add(words, langs, length, np.flatnonzero(whole & bits.has(keys)), keys, others)
                if len(counts.phrases) > MOST_SPOKEN:
                    yield from counts.rows()
                    counts = Spoken()
        yield from counts.rows()

    return spoken


def _summed(df: DataFrame, least: int, name: str) -> DataFrame:
    checks = [F.pmod(F.sum("c"), F.lit(CHECK)).alias("c")] if "c" in df.columns else []
    return written(df.groupBy("key").agg(F.sum("n").alias("n"), *checks).where(F.col("n") >= least), name)


def frequent_phrases(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     lang_column: str = "lang", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(lang, length, phrase, n): all phrases of one to four words that occur ``least`` times in
    a language, with their exact counts, and the number of words of each language as length 0.

    Null texts count as empty, a null language as ``NO_LANGUAGE``. Repeated rows count as often
    as they are there. An empty table gives nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, **{id_column: "long", text_column: "string", lang_column: "string"}).toDF("doc_id", "text", "lang")
    rows = rows.select(id_or_last().alias("doc_id"), "text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"))
    texts = rows.select("text", "lang")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    fields = "key long, n long, c long"

    def send(keys: DataFrame):
        return spark.sparkContext.broadcast(bitmap(keys))

    proposed = _summed(
        rows.where(place < int(share * (1 << 20))).select("text", "lang")
        .mapInArrow(freed(_counted(None, None, True)), "key long, n long"),
        max(2, int(LOWERED * share * least)), "proposed",
    )
    now, before = send(proposed), None
    found = _summed(texts.mapInArrow(freed(_counted(now, None, True)), fields), least, "frequent")
    known, fresh = proposed, found.join(proposed, "key", "left_anti")
    few = fresh.count() * FEW <= proposed.count()
    while not fresh.where(F.col("key").bitwiseAND(F.lit(3)) < LONGEST - 1).isEmpty():
        known = known.select("key").union(fresh.select("key"))
        now, before = send(known), now
        fresh = _summed(texts.mapInArrow(freed(_counted(now, before, False, few)), fields), least, "border")
        found = found.union(fresh)
        if few:
            break
    # different phrases that share a hash may be from different passes
    found = found.groupBy("key").agg(F.sum("n").alias("n"), F.pmod(F.sum("c"), F.lit(CHECK)).alias("c"))
    first = place < int(NAMED * (1 << 20))

    def read(docs: DataFrame, keys: DataFrame) -> DataFrame:
        return written(docs.select("text", "lang").mapInArrow(freed(_named(send(keys))), SPOKEN), "names")

    names = read(rows.where(first), found)
    names = names.union(read(rows.where(~first), found.join(names.where("length > 0"), "key", "left_anti")))
    one = names.where("length > 0").groupBy("key").agg(
        F.min(F.struct("lang", "length", "phrase", F.col("n").alias("second"))).alias("of")
    )
    same = F.pmod(F.pmod("n", F.lit(CHECK)) * F.col("of.second"), F.lit(CHECK)) == F.col("c")
    checked = written(found.join(one, "key", "left").select(
        "key", "of.lang", "of.length", "of.phrase", "n", F.coalesce(same, F.lit(False)).alias("sure")
    ), "checked")
    columns = ["lang", "length", "phrase", "n"]
    spoken = checked.where("sure").select(columns).union(names.where("length = 0").select(columns))
    shared = checked.where("not sure").select("key")
    if not shared.isEmpty():
        again = texts.mapInArrow(freed(_spoken(send(shared))), SPOKEN).join(shared, "key", "left_semi")
        spoken = spoken.union(again.select(columns))
    counts = spoken.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))
    return written(counts.where((F.col("n") >= least) | (F.col("length") == 0)), "phrases")


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 lang_column: str = "lang", least: int = LEAST, share: float = SHARE,
                 first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` best phrases of each language.

    A phrase of frequency a is cut behind its first k words into parts of frequencies l and r; its
    score is floor(2000000 a / (l + r)) of the cut where that is lowest, the smallest k of
    several. Phrases within a longer one that occurs nearly as often are left out. Order: score,
    a, then the phrase by its bytes. Nulls and repeats as in ``frequent_phrases``.
    """
    counts = frequent_phrases(docs, id_column, text_column, lang_column, least, share)
    phrases = counts.where("length > 0").withColumn("w", F.split("phrase", " "))
    parts = phrases.where(F.col("length") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    candidates = phrases.where("length > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "k",
        _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"),
    )
    both = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(
        parts.toDF("lang", "tail", "r"), ["lang", "tail"]
    )
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    scored = both.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("cut")
    ).select("lang", "phrase", "cut.*")
    sizes = F.sequence(F.lit(2), F.col("length") - 1)
    within = phrases.where("length > 2").withColumn("size", F.explode(sizes)).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1))
    ).select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "n")
    longest = within.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    many, few = COVERED
    kept = scored.join(longest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (F.col("longer").cast("decimal(20, 0)") * many < F.col("a").cast("decimal(20, 0)") * few)
    )
    ordered = kept.select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("s"), (-F.col("a")).alias("f"))
    ranked = with_running_total(ordered, ["s", "f", "phrase"], "lang").where(F.col("_running") <= first)
    totals = counts.where("length = 0").select("lang", F.col("n").alias("words"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("_running").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
