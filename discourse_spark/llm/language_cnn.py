"""Language identification by a small convolutional network over bytes, in numpy.

Texts are cut into windows of ``WINDOW`` bytes. Filters of widths 2, 3 and 4 slide over
the bytes of a window, each keeps its largest value, and a softmax over those values
gives a probability for each language. A text's answer is the mean over all its windows,
weighted by their letters. Training is plain stochastic gradient descent with momentum.

A byte is one of 256 symbols, so a filter is a sum of one table entry per place. For
prediction, tables of neighbouring places are added up once into tables of byte pairs,
which halves the look-ups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import bounded_sample, pick

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
SAMPLE = 2_400  # labelled texts that the network is fitted on
WINDOWS_EACH = 4  # windows taken from each of them
EPOCHS = 14
TOGETHER = 64  # windows predicted at once
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last filled up with spaces."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b" "), dtype=np.uint8).reshape(n, WINDOW)


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 3):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [random.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        inputs = FILTERS * len(WIDTHS)
        self.out = random.normal(0, 0.3, (inputs, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)
        self._pairs = None

    def __getstate__(self):
        return {**self.__dict__, "_pairs": None}

    def _responses(self, windows: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
        n = WINDOW - width + 1
        return sum(table[j][windows[:, j : j + n]] for j in range(width))

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08,
            batch: int = 64, seed: int = 5) -> ByteNetwork:
        random = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        speed = [np.zeros_like(p) for p in params]
        for epoch in range(epochs):
            order = random.permutation(len(windows))
            step = rate / (1 + 0.25 * epoch)
            for first in range(0, len(order), batch):
                some = order[first : first + batch]
                for p, v, g in zip(params, speed, self._gradients(windows[some], labels[some])):
                    v *= 0.9
                    v -= step * g
                    p += v
        self._pairs = None
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        rows = np.arange(len(windows))
        pooled, best = [], []
        for width, table in zip(WIDTHS, self.tables):
            response = self._responses(windows, width, table)
            at = response.argmax(axis=1)
            best.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :])
        pooled = np.concatenate(pooled, axis=1)
        wrong = self._softmax(pooled)
        wrong[rows, labels] -= 1
        wrong /= len(rows)
        back = wrong @ self.out.T
        gradients = []
        filters = np.arange(FILTERS)
        for k, (width, table) in enumerate(zip(WIDTHS, self.tables)):
            g = np.zeros_like(table)
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                symbol = np.take_along_axis(windows, best[k] + j, axis=1)
                np.add.at(g[j], (symbol, filters[None, :]), own)
            gradients.append(g + 1e-5 * table)
        return [*gradients, pooled.T @ wrong + 1e-4 * self.out, wrong.sum(axis=0)]

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window.

        Places come first here and windows second, so that sums and maxima run over
        long contiguous rows.
        """
        if self._pairs is None:
            self._pairs = [
                [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, len(t) - 1, 2)]
                for t in self.tables
            ]
        wide = np.ascontiguousarray(windows.T).astype(np.intp)
        pairs = (wide[:-1] << 8) + wide[1:]
        pooled = []
        for width, table, joint in zip(WIDTHS, self.tables, self._pairs):
            n = WINDOW - width + 1
            response = joint[0].take(pairs[:n], axis=0)
            for k in range(1, len(joint)):
                response += joint[k].take(pairs[2 * k : 2 * k + n], axis=0)
            if width % 2:
                response += table[width - 1].take(wide[width - 1 : width - 1 + n], axis=0)
            pooled.append(response.reshape(n, -1).max(axis=0).reshape(len(windows), FILTERS))
        return self._softmax(np.concatenate(pooled, axis=1))


def fit(labelled: DataFrame, lang_column: str = "lang", text_column: str = "text",
        sample: int = SAMPLE) -> ByteNetwork | None:
    """A network fitted on at most ``sample`` of the rows that have a text and a language,
    chosen by a hash of the text, so that equal tables give equal networks. None if
    there are no such rows."""
    rows = pick(labelled, **{lang_column: "string", text_column: "string"}).toDF("lang", "text")
    rows = rows.where("lang is not null and text rlike '[\\\\p{L}]'")
    picked = bounded_sample(rows.withColumn("h", F.xxhash64("text", "lang")), "h", sample)
    if not picked:
        return None
    languages = sorted({r["lang"] for r in picked})
    windows, labels = [], []
    for r in picked:
        own = windows_of(r["text"].encode("utf-8", "surrogatepass"))
        seed = int.from_bytes(hashlib.blake2b(r["text"].encode("utf-8", "surrogatepass"), digest_size=4).digest())
        chosen = np.random.default_rng(seed).permutation(len(own))[:WINDOWS_EACH]
        windows.append(own[chosen])
        labels += [languages.index(r["lang"])] * len(chosen)
    return ByteNetwork(languages).fit(np.concatenate(windows), np.array(labels))


def _predicted(network: ByteNetwork):
    def predicted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, scores = [], []
            for text in part["text"]:
                lang, score = answer(network, text)
                langs.append(lang)
                scores.append(score)
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": langs, "score": scores})

    return predicted


def answer(network: ByteNetwork | None, text: str | None) -> tuple[str, float]:
    if network is None or not text or not _LETTER.search(text):
        return UNKNOWN, 0.0
    windows = windows_of(text.encode("utf-8", "surrogatepass"))
    total = np.zeros(len(network.languages))
    weight = 0.0
    for first in range(0, len(windows), TOGETHER):
        some = windows[first : first + TOGETHER]
        letters = ((some | 0x20) - 97 < 26) | (some >= 0x80)
        own = letters.sum(axis=1) + 1e-3
        total += own @ network.predict(some)
        weight += own.sum()
    best = int(total.argmax())
    return network.languages[best], float(min(1.0, total[best] / weight))


def predict(docs: DataFrame, network: ByteNetwork | None, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row; ``und`` with score 0 for a null text, one
    without a letter, or no network. The score is the mean probability. Ties go to the
    language that sorts first."""
    rows = pick(docs, **{id_column: "string", text_column: "string"}).toDF("doc_id", "text")
    done = rows.mapInPandas(_predicted(network), "doc_id string, lang_pred string, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
