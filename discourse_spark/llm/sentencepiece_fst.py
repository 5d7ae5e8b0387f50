"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

The transducer is compiled from a model file in three parts: the normaliser (a leading
space, spaces to the visible space sign), the pieces (a trie whose final states emit an
id), and the byte fallback (a character that no piece holds becomes its bytes).
Composed with an input it is a lattice: states are positions, arcs are pieces, and the
encoding is the path of least weight in the tropical semiring.

Weights depend on the kind of model. In a unigram model an arc weighs the negative
score of its piece. In a BPE model the encoding is fixed by merges, not by a sum of
scores; there a state also knows the last piece, and an arc weighs 0 if the two pieces
can stand side by side and infinity if not. Two pieces can if encoding their joint
string gives just these two, and a sequence is the encoding of its string exactly if
all its neighbours can. So one path of weight 0 is left, and it is found depth first:
the first path that reaches the end is the shortest.

No piece reaches from another character into a space, nor from a letter to a mark, so
words and marks are composed one by one, and each distinct one once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import pick, ship

SIGN = "▁"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LETTER = re.compile(f"[{LETTERS}]")
INFINITE = float("inf")
MOST_WORDS = 800_000  # cached words and piece pairs; the caches start anew beyond that


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only models whose normaliser keeps characters are compiled here")
        self.lead = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.merges = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        if model.trainer_spec.model_type not in (proto.TrainerSpec.BPE, proto.TrainerSpec.UNIGRAM):
            raise ValueError("neither a unigram nor a BPE model")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10.0
        self.longest = max(map(len, self.ids))
        self.begins = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}  # the states of the trie
        self.text_of = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE
            else b"" if p.type == kinds.CONTROL
            else " ⁇ ".encode() if p.type == kinds.UNKNOWN
            else p.piece.replace(SIGN, " ").encode()
            for p in model.pieces
        ]
        self.cut = self._cut_rule()
        self.words = _Cache(self._word)
        self.pairs = _Cache(self._fits)
        self.stable = _Cache(lambda piece: self._merged(piece) == [piece])

    def _cut_rule(self) -> re.Pattern:
        """Where texts can be cut: no piece holds the characters on both sides."""
        crossing = {(a, b) for p in self.ids for a, b in zip(map(_kind, p), map(_kind, p[1:]))}
        if any(b == "space" and a != "space" for a, b in crossing):
            return re.compile(".+", re.DOTALL)
        if {("letter", "mark"), ("mark", "letter")} & crossing or any("line" in x for x in crossing):
            return re.compile(" *[^ ]+| +")
        return re.compile(f" *[{LETTERS}]+| *[^ \n{LETTERS}]+| +|\n")

    # encoding

    def normalise(self, text: str) -> str:
        text = text.replace(SIGN, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if text and self.lead else text

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; a null or empty text has none."""
        for cache in (self.words, self.pairs):
            if len(cache) > MOST_WORDS:
                cache.clear()
        words = self.cut.findall(self.normalise(text or ""))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.uint32)

    def _word(self, word: str) -> bytes:
        ids = array("I")
        search = self.merge_path if self.merges else self.path
        for piece in search(word.replace(" ", SIGN)):
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids.tobytes()

    def path(self, word: str) -> list[str]:
        """The pieces on the path of least weight. Positions come in topological order, so one
        pass relaxes every arc. Of equal weights the first stays."""
        n = len(word)
        weight = [INFINITE] * (n + 1)
        last: list[str] = [""] * (n + 1)
        weight[0] = 0.0
        for at in range(n):
            for piece in self._arcs(word, at):
                score = self.scores[self.ids[piece]] if piece in self.ids else self.unknown_score
                total, end = weight[at] - score, at + len(piece)
                if total < weight[end]:
                    weight[end], last[end] = total, piece
        pieces = []
        at = n
        while at:
            pieces.append(last[at])
            at -= len(last[at])
        return pieces[::-1]

    def merge_path(self, word: str) -> list[str]:
        """The only path of weight 0, with longer pieces tried first. A prefix has one
        encoding, so a position that led nowhere once is closed for good."""
        n, at = len(word), 0
        closed = bytearray(n + 1)
        pieces: list[str] = []
        open_arcs = [self._arcs(word, 0)]
        while at < n:
            before = pieces[-1] if pieces else ""
            arcs = open_arcs[-1]
            while arcs:
                piece = arcs.pop()
                if not closed[at + len(piece)] and self._weight(before, piece) == 0.0:
                    pieces.append(piece)
                    at += len(piece)
                    open_arcs.append(self._arcs(word, at))
                    break
            else:
                closed[at] = 1
                open_arcs.pop()
                at -= len(pieces.pop())
        return pieces

    def _arcs(self, word: str, at: int) -> list[str]:
        """The pieces that leave a position, short ones first. A character that is no piece
        leaves alone."""
        arcs = []
        for end in range(at + 1, min(len(word), at + self.longest) + 1):
            piece = word[at:end]
            if piece not in self.begins:
                break
            if piece in self.ids:
                arcs.append(piece)
        if at < len(word) and (not arcs or len(arcs[0]) > 1):
            arcs.insert(0, word[at])
        return arcs

    def _weight(self, before: str, piece: str) -> float:
        """In a BPE model: of a piece behind another one."""
        if len(piece) > 1 and not self.stable[piece]:
            return INFINITE
        return 0.0 if not before or self.pairs[before, piece] else INFINITE

    def _fits(self, pair: tuple[str, str]) -> bool:
        return self._merged(pair[0] + pair[1]) == list(pair)

    def _merged(self, text: str) -> list[str]:
        """The merges of a short string: always the best scored neighbours, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = -INFINITE, -1
            for i in range(len(parts) - 1):
                score = self.ids.get(parts[i] + parts[i + 1])
                if score is not None and self.scores[score] > best:
                    best, where = self.scores[score], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the leading space that the normaliser adds."""
        data = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        if self.lead and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def _kind(character: str) -> str:
    if character == SIGN:
        return "space"
    if character == "\n":
        return "line"
    return "letter" if _LETTER.match(character) else "mark"


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One compiled transducer per worker and file."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def _encoded(path: str):
    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from discourse_spark.llm.sentencepiece_fst import transducer

        own = transducer(path)
        for part in parts:
            ids = [own.encode(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [x.astype("<u4").tobytes() for x in ids]})

    return encoded


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit numbers.

    Null and empty texts have no ids. Repeated rows repeat, null ids come back as null.
    """
    ship(docs.sparkSession)
    rows = pick(docs, **{id_column: "string", text_column: "string"}).toDF("doc_id", "text")
    done = rows.mapInPandas(_encoded(model_path), "doc_id string, ids binary")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def _decoded(path: str):
    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from discourse_spark.llm.sentencepiece_fst import transducer

        own = transducer(path)
        for part in parts:
            ids = [np.frombuffer(x if x is not None else b"", dtype="<u4") for x in part["ids"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [own.decode(x) for x in ids]})

    return decoded


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of a table made by ``encode``. Null ids give an empty text."""
    ship(encoded.sparkSession)
    done = pick(encoded, doc_id="string", ids="binary").mapInPandas(_decoded(model_path), "doc_id string, text string")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def _checked(path: str):
    def checked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from discourse_spark.llm.sentencepiece_fst import transducer

        own = transducer(path)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids = own.encode(text)
                back = own.decode(ids)
                rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), back == (text or "")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return checked


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): digests of the ids, and whether decoding gives
    the text again. It does unless the text holds the visible space sign itself."""
    ship(docs.sparkSession)
    rows = pick(docs, **{id_column: "string", text_column: "string"}).toDF("doc_id", "text")
    done = rows.mapInPandas(
        _checked(model_path), "doc_id string, n_tokens long, ids_crc32 long, round_trip boolean"
    )
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
