"""Token ids of whole texts, with each distinct word given to the tokenizer once.

Both vocabularies here cut a text into words before anything is merged, so a word's ids
depend on the word alone. A text of plain characters (``PLAIN``: ASCII without control
characters but the line feed, and Latin-1) is cut with the vocabulary's own rule,
and each word that is new goes to the BPE model of the tokenizers library. Any other
text goes to the library in pieces, cut at single spaces between visible characters,
where no word can reach across. Ids equal those of ``Tokenizer.encode`` on the whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

MOST_WORDS = 500_000  # cached; the cache starts anew beyond that
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
PLAIN = re.compile("[\n -~¡-¬®-ÿ]*")
# fixed values: the word rules of the two vocabularies, for plain characters
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = re.compile(rf"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
LOWERED = re.compile(rf"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
# characters that are no white space and combine with nothing, in any Unicode version
VISIBLE = "!-~¡-¬®-ɏΑ-ΡΣ-ωА-я"
CUT = re.compile(f"(?<=[{VISIBLE}])(?= [{VISIBLE}])")


class WordEncoder:
    """Encodes texts with the tokenizer file at ``path``; ids come as numpy arrays."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4") if wide else np.dtype("<u2")
        # a vocabulary of words drops spaces and lowers letters; the other keeps the space
        self.lowers = isinstance(self.tokenizer.normalizer, normalizers.Sequence)
        known = self.lowers or (
            self.tokenizer.normalizer is None
            and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        )
        if not known:
            raise ValueError(f"{path} is not one of the two kinds of vocabulary known here")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = LOWERED if self.lowers else SPACED
        self.letters = _byte_letters()
        self.words = _Words(self._word)
        self.pieces = _Words(self._piece)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.kind)
        for cache in (self.words, self.pieces):
            if len(cache) > MOST_WORDS:
                cache.clear()
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            words = self.cut.findall(text.lower() if self.lowers else text)
            found = map(self.words.__getitem__, words)
        else:
            found = map(self.pieces.__getitem__, CUT.split(text))
        return np.frombuffer(b"".join(found), dtype=self.kind)

    def _word(self, word: str) -> bytes:
        unit = word.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(unit)])

    def _piece(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand
    for themselves, the others, in order, for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
