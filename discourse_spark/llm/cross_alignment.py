"""Alignment of the tokens of two vocabularies over the same bytes.

Each text is encoded twice, and both token sequences are laid over its bytes. Where a token
of either sequence ends at the same byte, the text can be cut for both. The cuts are found by
divide and conquer: an interval that ends at a common cut looks for another one near its
middle, by bisecting the ends of one side for an end of the other, and splits there; an
interval without one is a leaf, a group of tokens that only fit each other as a whole. All
intervals of one depth, of all texts of a batch, are split in one step of array operations.

Two tokens that end together are linked. One of the two is a suffix of the other, as both end
at the same byte of the same text. So the two vocabularies alone say which pairs of ids can ever
be linked: ``possible_pairs`` lists them, some hundred thousand, however large the corpus is.
Counts over the corpus are kept by place in that list, which bounds what a task counts into,
what comes to the driver and what is broadcast.

Texts are encoded once. What one document gives, its digests and the places of its links, is
written to the shared folder; counting and the columns that need corpus counts read that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import pick, ship, written
from discourse_spark.llm.tokens import WordEncoder

SIGN = "▁"
BATCH = 1 << 20  # bytes of text that are aligned together; a longer text is alone
CACHED_WORDS = 500_000
WINDOWS = (0, 4, 64, 1024)  # distances from the middle in which a cut is looked for, then all


# tokens and their bytes


class Side:
    """A vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.sizes = np.array([len(b) for b in token_bytes], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library. It gets a space and the text; strings
    of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        self.words.tokenizer.encode_special_tokens = True
        self.words.special = []
        letters = {chr(b): b for b in range(256) if b not in self.words.letters}
        letters |= {letter: byte for byte, letter in self.words.letters.items()}
        size = self.words.tokenizer.get_vocab_size()
        names = [self.words.tokenizer.id_to_token(i) or "" for i in range(size)]
        super().__init__([
            bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names
        ])

    def encode(self, text: str) -> np.ndarray:
        for cache in (self.words.words, self.words.pieces):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        return self.words.encode(" " + text).astype(np.int64)


class Pieces(Side):
    """A sentencepiece model. It gets the text and adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        super().__init__([self._bytes(i) for i in range(self.model.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.model.is_control(i) else piece.replace(SIGN, " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)


_SIDES: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """The two vocabularies, loaded once per worker."""
    if (a_path, b_path) not in _SIDES:
        _SIDES[a_path, b_path] = (ByteLevel(a_path), Pieces(b_path))
    return _SIDES[a_path, b_path]


def possible_pairs(a: Side, b: Side) -> np.ndarray:
    """All pairs of ids that can end together, as sorted ``a * size of b + b``: those in which
    the bytes of one are a suffix of the bytes of the other."""
    ids_a, ids_b = _by_bytes(a), _by_bytes(b)
    found = set()
    for shorter, longer, flip in ((ids_b, ids_a, False), (ids_a, ids_b, True)):
        for token, own in longer.items():
            for k in range(len(token)):
                for i in own:
                    for j in shorter.get(token[k:], ()):
                        found.add((j, i) if flip else (i, j))
    return np.sort(np.array([i * len(b.sizes) + j for i, j in found], dtype=np.int64))


def _by_bytes(side: Side) -> dict[bytes, list[int]]:
    by_bytes: dict[bytes, list[int]] = {}
    for i, token in enumerate(side.token_bytes):
        if token:
            by_bytes.setdefault(token, []).append(i)
    return by_bytes


# divide and conquer


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray,
                last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, in either array of rising ends, of all ends that both have.

    ``last_a`` and ``last_b`` are places of cuts that are known, the last of either array
    among them; the intervals between those are split until they hold no further cut.
    """
    cut_a, cut_b = [last_a], [last_b]
    # an interval: tokens from .. to (inclusive), where the ends of the last two are the same
    from_a, from_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    to_a, to_b = last_a, last_b
    while len(to_a):
        # with one token on a side there is nothing to cut
        open_ = (to_a > from_a) & (to_b > from_b)
        from_a, to_a, from_b, to_b = from_a[open_], to_a[open_], from_b[open_], to_b[open_]
        at_a, at_b = _near_middle(ends_a, ends_b, from_a, to_a)
        some = at_a >= 0
        from_a, to_a, from_b, to_b = from_a[some], to_a[some], from_b[some], to_b[some]
        at_a, at_b = at_a[some], at_b[some]
        cut_a.append(at_a)
        cut_b.append(at_b)
        from_a, to_a = _halves(from_a, at_a, to_a)
        from_b, to_b = _halves(from_b, at_b, to_b)
    return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))


def _halves(first: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops = np.empty(2 * len(at), dtype=np.int64), np.empty(2 * len(at), dtype=np.int64)
    starts[0::2], starts[1::2] = first, at + 1
    stops[0::2], stops[1::2] = at, last
    return starts, stops


def _near_middle(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray,
                 last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval a common end before its last one, near the middle, or -1."""
    at_a, at_b = np.full(len(first), -1), np.full(len(first), -1)
    middle = (first + last - 1) // 2
    todo = np.arange(len(first))
    for width in (*WINDOWS, None):
        if not len(todo):
            break
        low = first[todo] if width is None else np.maximum(first[todo], middle[todo] - width)
        high = last[todo] - 1 if width is None else np.minimum(last[todo] - 1, middle[todo] + width)
        n = high - low + 1
        owner = np.repeat(np.arange(len(todo)), n)
        tried = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]
        place = np.searchsorted(ends_b, ends_a[tried])
        hit = np.flatnonzero(ends_b[place] == ends_a[tried])
        if len(hit):
            if width != 0:  # the nearest to the middle, of two the first
                away = np.abs(tried[hit] - middle[todo][owner[hit]])
                hit = hit[np.lexsort((tried[hit], away, owner[hit]))]
            of, nearest = np.unique(owner[hit], return_index=True)
            at_a[todo[of]], at_b[todo[of]] = tried[hit[nearest]], place[hit[nearest]]
        searched_all = (low == first[todo]) & (high == last[todo] - 1)
        todo = todo[(at_a[todo] < 0) & ~searched_all]
    return at_a, at_b


# texts


@dataclass
class Aligned:
    """Token ids of a batch of texts, one behind the other, and the groups they form."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    cuts_a: np.ndarray  # the last token of each group
    cuts_b: np.ndarray
    groups: np.ndarray  # groups before each text, and all of them
    bounds_a: np.ndarray  # tokens before each text, and all of them
    bounds_b: np.ndarray


def align(texts: list[str | None], a: Side, b: Side) -> Aligned:
    """Align whole texts. Null and empty texts, and those that either side doesn't give back
    byte by byte, have no tokens."""
    none = np.zeros(0, dtype=np.int64)
    ids: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        pair = (none, none)
        if text:
            whole = (" " + text).encode("utf-8", "surrogatepass")
            both = (a.encode(text), b.encode(text))
            if a.joined(both[0]) == whole and b.joined(both[1]) == whole:
                pair = both
        ids.append(pair)
    ids_a, ids_b = (np.concatenate([none, *(p[k] for p in ids)]) for k in (0, 1))
    bounds_a, bounds_b = (np.cumsum([0, *(len(p[k]) for p in ids)]) for k in (0, 1))
    some = np.diff(bounds_a) > 0
    cuts_a, cuts_b = common_cuts(
        np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]), bounds_a[1:][some] - 1, bounds_b[1:][some] - 1
    )
    return Aligned(ids_a, ids_b, cuts_a, cuts_b, np.searchsorted(cuts_a, bounds_a), bounds_a, bounds_b)


class Names:
    """The decimal digits of ids with a mark behind them, as rows of equal width."""

    def __init__(self, size: int):
        digits = [str(i).encode() for i in range(size)]
        self.width = max(map(len, digits)) + 1
        self.letters = np.zeros((size, self.width), dtype=np.uint8)
        self.sizes = np.array([len(d) for d in digits])
        for i, d in enumerate(digits):
            self.letters[i, : len(d)] = list(d)


def group_names(found: Aligned, names: Names) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    n_a, n_b = len(found.ids_a), len(found.ids_b)
    if not n_a:
        return [b""] * (len(found.groups) - 1)
    group_a = np.searchsorted(found.cuts_a, np.arange(n_a))
    group_b = np.searchsorted(found.cuts_b, np.arange(n_b))
    # the tokens of a group on one side come behind those of earlier groups and, for the other, its own
    place = np.empty(n_a + n_b, dtype=np.int64)
    place[:n_a] = np.arange(n_a) + np.append(0, found.cuts_b + 1)[group_a]
    place[n_a:] = np.arange(n_b) + (found.cuts_a + 1)[group_b]
    mark = np.full(n_a + n_b, ord(","), dtype=np.uint8)
    mark[found.cuts_a] = ord("|")
    mark[n_a + found.cuts_b] = ord(";")
    ids = np.empty(n_a + n_b, dtype=np.int64)
    ids[place] = np.concatenate([found.ids_a, found.ids_b])
    marks = np.empty(n_a + n_b, dtype=np.uint8)
    marks[place] = mark
    letters, sizes = names.letters[ids], names.sizes[ids]
    letters[np.arange(len(ids)), sizes] = marks
    whole = letters[np.arange(names.width) <= sizes[:, None]].tobytes()
    at = np.append(0, np.cumsum(sizes + 1))[found.bounds_a + found.bounds_b]
    return [whole[i : j - 1] if j > i else b"" for i, j in zip(at[:-1], at[1:])]


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > BATCH:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


FIELDS = "doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _measured(a_path: str, b_path: str, pairs):
    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from discourse_spark.llm.cross_alignment import Names, _batches, align, group_names, sides

        a, b = sides(a_path, b_path)
        known = pairs.value
        names = Names(max(len(a.sizes), len(b.sizes)))
        for part in parts:
            doc_ids, texts = part["doc_id"].tolist(), part["text"].tolist()
            for first, last in _batches(texts):
                found = align(texts[first:last], a, b)
                pair = found.ids_a[found.cuts_a] * len(b.sizes) + found.ids_b[found.cuts_b]
                places = np.searchsorted(known, pair).astype("<u4")
                at = found.groups
                yield pd.DataFrame({
                    "doc_id": doc_ids[first:last],
                    "n_a": np.diff(found.bounds_a), "n_b": np.diff(found.bounds_b), "n_groups": np.diff(at),
                    "groups_sha256": [
                        hashlib.sha256(g).hexdigest() if g else "" for g in group_names(found, names)
                    ],
                    "links": [places[i:j].tobytes() for i, j in zip(at[:-1], at[1:])],
                })

    return measured


def _counted(size: int):
    """How often each place occurs in the rows of a task."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for part in parts:
            for links in part["links"]:
                places = np.frombuffer(links, dtype="<u4")
                if len(places) < size // 4:
                    np.add.at(total, places, 1)
                else:
                    total += np.bincount(places, minlength=size)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"pair": some, "n": total[some]})

    return counted


def _totalled(counts):
    def totalled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, best = counts.value
        for part in parts:
            places = [np.frombuffer(links, dtype="<u4") for links in part["links"]]
            yield part.drop(columns="links").assign(
                n_best=[int(best[p].sum()) for p in places], count_sum=[int(n[p].sum()) for p in places]
            )

    return totalled


@dataclass
class Alignment:
    """What ``align_documents`` gives: ``documents`` has one row per document, ``pairs`` one per
    linked pair of ids, (a, b, n, is_best), with ``is_best`` for the most frequent of a b."""

    documents: DataFrame
    pairs: DataFrame


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id",
                    text_column: str = "text") -> Alignment:
    """Align all documents by a byte-level file and a piece model, and count linked pairs over all.

    ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A text
    that is null or empty, or that either vocabulary doesn't give back byte by byte, has no
    tokens: zeros and an empty digest. Ties for the highest count of a b all count. Repeated
    rows repeat and are counted each; null ids come back as null. An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    a, b = sides(a_path, b_path)
    known = possible_pairs(a, b)
    pairs = spark.sparkContext.broadcast(known)
    rows = pick(docs, **{id_column: "string", text_column: "string"}).toDF("doc_id", "text")
    measured = written(rows.mapInPandas(_measured(a_path, b_path, pairs), FIELDS), "aligned")
    sums = measured.select("links").mapInPandas(_counted(len(known)), "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")
    ).toArrow()  # at most one row for each possible pair
    n = np.zeros(len(known), dtype=np.int64)
    n[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    highest = np.zeros(len(b.sizes), dtype=np.int64)
    np.maximum.at(highest, known % len(b.sizes), n)
    best = (n == highest[known % len(b.sizes)]) & (n > 0)
    counts = spark.sparkContext.broadcast((n, best))
    done = measured.mapInPandas(
        _totalled(counts),
        "doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long",
    ).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups",
        F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256",
    )
    linked = np.flatnonzero(n)
    table = pd.DataFrame({
        "a": known[linked] // len(b.sizes), "b": known[linked] % len(b.sizes), "n": n[linked],
        "is_best": best[linked],
    })
    return Alignment(done, spark.createDataFrame(table, "a long, b long, n long, is_best boolean"))
