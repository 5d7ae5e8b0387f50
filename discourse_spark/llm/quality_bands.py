"""Quality rules: word, symbol and repetition counts, and bands of compression ratios.

The ratio of zstandard's output to its input tells how repetitive a text is (low) or how
random (high). It is taken for the whole document and for each fixed chunk of it, the
last chunk being what is left, if that is at least half a chunk. Short inputs compress
worse whatever they say, so the limits go by length. A document is rejected if the
whole lies outside its band, or if the bytes of chunks outside theirs reach a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import pick
from discourse_spark.llm.words import batches, shingles_of, words_of

LEVEL = 3
CHUNK = 4096
# (bytes from, lowest ratio, highest ratio)
BANDS = (
    (0, 0.50, 2.00), (100, 0.45, 1.20), (200, 0.42, 0.95), (400, 0.35, 0.85), (1000, 0.28, 0.78),
    (2000, 0.24, 0.75), (4000, 0.20, 0.72), (10_000, 0.16, 0.70),
)
BAD_SHARE = 0.5  # of the bytes in chunks
WIDTH = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ratio_limits(size: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if size >= start)


def compression(text: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole, share of chunk bytes outside their band, whether it passes)."""
    if not text:
        return 0.0, 0.0, True
    whole = len(pack.compress(text)) / len(text)
    low, high = ratio_limits(len(text))
    good = low <= whole <= high
    bad = seen = 0
    for at in range(0, len(text), CHUNK):
        chunk = text[at : at + CHUNK]
        if 2 * len(chunk) < CHUNK:
            break
        low, high = ratio_limits(len(chunk))
        seen += len(chunk)
        bad += 0 if low <= len(pack.compress(chunk)) / len(chunk) <= high else len(chunk)
    share = bad / seen if seen else 0.0
    return whole, share, good and share < BAD_SHARE


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, how many words lie in a window of WIDTH words that it has twice or more."""
    shingles, at = shingles_of(hashes, bounds, WIDTH)
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((shingles, text))
    same = (shingles[order][1:] == shingles[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(shingles), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    windows = np.flatnonzero(twice)
    first_word = windows - at[text[windows]] + bounds[text[windows]]
    marks = np.zeros(len(hashes) + WIDTH + 1, dtype=np.int32)
    np.add.at(marks, first_word, 1)
    np.add.at(marks, first_word + WIDTH, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(marks)[: len(hashes)] > 0)))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for part in parts:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
        for first, last in batches(texts):
            own = texts[first:last]
            hashes, bounds, buffer, starts, ends = words_of(own)
            # a character is a byte that does not continue one
            letters = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
            word_letters = np.concatenate(([0], np.cumsum(letters[ends] - letters[starts])))
            symbols = np.concatenate(([0], np.cumsum(SYMBOLS[buffer])))
            text_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
            text_at[-1] = len(buffer)
            n_words = np.diff(bounds)
            n_repeat = repeated_words(hashes, bounds)
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            packed = [compression(t, pack) for t in own]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].iloc[first:last].to_numpy(),
                "n_words": n_words,
                "word_chars": word_letters[bounds[1:]] - word_letters[bounds[:-1]],
                "n_symbols": symbols[text_at[1:]] - symbols[text_at[:-1]],
                "n_dup_lines": [repeated_lines(t) for t in own],
                "n_repeat_words": n_repeat,
                "base_failed": failed,
                "kept": ~failed & np.array([p[2] for p in packed]),
                "ratio": [p[0] for p in packed],
                "bad_share": [p[1] for p in packed],
            })


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``kept``, and the figures behind
    the verdict: ``ratio`` of the whole text and ``bad_share`` of chunks outside their band.

    A null text counts as empty: no words, ratio 0, failed. Repeated rows repeat; null
    ids come back as null. Texts are used whole whatever their length.
    """
    rows = pick(docs, **{id_column: "long", text_column: "string"}).toDF("doc_id", "text")
    # ids travel as text, since a null would turn numbers into floats in pandas
    measured = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        _measured,
        "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double",
    )
    return measured.withColumn("doc_id", F.col("doc_id").cast("long"))
