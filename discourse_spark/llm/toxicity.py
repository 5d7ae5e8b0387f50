"""Toxicity scores by a classifier that is regularised with counterfactuals.

A logistic regression over the words of a text and their beginnings. Labelled texts that
name a group of people get a twin in which each such term is swapped for another of its
kind; the squared difference of the two scores is part of the loss. A term then can't
carry weight just because toxic texts happen to name it more often, which is what makes
neutral mentions of a group look toxic.

Fitting takes a bounded sample of labelled texts to the driver; scoring is one pass over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import bounded_sample, freed, pick, position, text_batches
from discourse_spark.llm.words import LOWER, batches, span_hashes, words_of

SAMPLE = 8_000  # labelled texts to fit on
FEATURES = 4_096
LEAST_TEXTS = 4  # that hold a feature
PREFIXES = (4, 5)
PENALTY = 1.0  # weight of the counterfactual term
DECAY = 2e-4
STEPS = 400
THRESHOLD = 0.3

# Terms that name a group of people, by kind. Only terms of one kind are swapped, so forms of
# one number, part of speech and language are a kind. No term is in two kinds; what two
# languages share is in the first. Capitals beyond ASCII are forms of their own.
IDENTITY_TERMS = {
    "gender": ("women", "men", "girls", "boys", "transgender"),
    "gender, one": ("woman", "man", "girl", "boy"),
    "gender, adjectives": ("female", "male"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    "religion, one": ("muslim", "christian", "jew", "hindu", "buddhist", "atheist"),
    "religion, adjectives": ("islamic", "jewish", "catholic", "protestant"),
    "origin": ("immigrants", "refugees", "foreigners", "natives", "africans", "asians", "europeans", "mexicans"),
    "origin, one": ("immigrant", "refugee", "foreigner", "native", "african", "asian", "european", "mexican"),
    "origin, more": ("migrants", "arabs", "turks", "americans", "indians"),
    "origin, one more": ("migrant", "arab", "turk", "american", "indian"),
    "origin, adjectives": ("foreign", "arabic", "turkish", "chinese"),
    "orientation": ("gay", "lesbian", "straight", "bisexual"),
    "orientation, many": ("gays", "lesbians", "homosexuals", "heterosexuals", "bisexuals"),
    "orientation, one": ("homosexual", "heterosexual"),
    "colour": ("black", "white", "brown"),
    "colour, many": ("blacks", "whites"),
    "ability": ("disabled", "deaf", "blind", "autistic"),
    "age": ("elderly", "teenagers", "millennials"),
    "age, one": ("teenager", "millennial", "pensioner"),
    "gender, de": ("frauen", "männer", "mädchen", "jungen"),
    "gender, one, de": ("frau", "mann", "junge"),
    "gender, adjectives, de": ("weibliche", "männliche"),
    "religion, de": ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    "religion, women, de": ("musliminnen", "christinnen", "jüdinnen"),
    "religion, one, de": ("moslem", "christ", "jude"),
    "religion, one woman, de": ("muslimin", "christin", "jüdin"),
    "religion, adjectives, de": ("muslimische", "christliche", "jüdische", "katholische"),
    "religion, inflected, de": ("muslimischen", "christlichen", "jüdischen", "katholischen"),
    "origin, de": ("einwanderer", "flüchtlinge", "ausländer", "afrikaner", "asiaten", "europäer", "mexikaner",
                   "araber", "türken", "migranten"),
    "origin, one, de": ("flüchtling", "asiate", "türke"),
    "origin, adjectives, de": ("ausländische", "afrikanische", "asiatische", "europäische", "arabische", "türkische"),
    "orientation, de": ("schwule", "lesben", "homosexuelle", "heterosexuelle", "bisexuelle"),
    "orientation, adjectives, de": ("schwul", "lesbisch"),
    "colour, de": ("schwarze", "weiße", "braune"),
    "ability, de": ("behinderte", "gehörlose", "blinde", "autisten"),
    "age, de": ("senioren", "rentner", "jugendliche"),
    "gender, fr": ("femmes", "hommes", "filles", "garçons"),
    "gender, one, fr": ("femme", "homme", "fille", "garçon"),
    "religion, fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    "religion, one, fr": ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    "religion, women, fr": ("musulmanes", "chrétiennes", "juives"),
    "religion, one woman, fr": ("musulmane", "chrétienne", "juive"),
    "origin, fr": ("immigrés", "réfugiés", "étrangers", "Étrangers", "africains", "asiatiques", "européens",
                   "mexicains", "arabes", "turcs"),
    "origin, one, fr": ("immigré", "réfugié", "étranger", "Étranger", "africain", "asiatique", "européen",
                        "mexicain", "arabe", "turc"),
    "origin, one woman, fr": ("immigrée", "réfugiée", "étrangère", "Étrangère", "africaine", "européenne",
                              "mexicaine", "turque"),
    "orientation, fr": ("lesbiennes", "homosexuels", "hétérosexuels", "bisexuels"),
    "orientation, one, fr": ("lesbienne", "homosexuel", "hétérosexuel", "bisexuel"),
    "colour, fr": ("noirs", "blancs"),
    "colour, one, fr": ("noir", "blanc"),
    "colour, one woman, fr": ("noire", "blanche"),
    "ability, fr": ("handicapés", "sourds", "aveugles", "autistes"),
    "age, fr": ("retraités", "adolescents"),
    "gender, es": ("mujeres", "hombres", "chicas", "chicos"),
    "gender, one, es": ("mujer", "hombre", "chica", "chico"),
    "religion, es": ("cristianos", "judíos", "hindúes", "budistas", "ateos"),
    "religion, one, es": ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    "religion, one woman, es": ("musulmana", "cristiana", "judía", "atea"),
    "origin, es": ("inmigrantes", "refugiados", "extranjeros", "africanos", "asiáticos", "europeos", "mexicanos",
                   "árabes", "Árabes", "turcos"),
    "origin, one, es": ("inmigrante", "refugiado", "extranjero", "africano", "asiático", "europeo", "mexicano",
                        "árabe", "Árabe", "turco"),
    "origin, one woman, es": ("refugiada", "extranjera", "africana", "asiática", "europea", "mexicana", "turca"),
    "orientation, es": ("lesbianas", "homosexuales", "heterosexuales", "bisexuales"),
    "colour, es": ("negros", "blancos"),
    "colour, one, es": ("negro", "blanco"),
    "colour, one woman, es": ("negra", "blanca"),
    "ability, es": ("discapacitados", "sordos", "ciegos", "autistas"),
    "age, es": ("ancianos", "jubilados", "adolescentes"),
}

# words here are runs of ASCII letters and digits and of anything beyond ASCII
BREAK = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])


def _salted(hashes: np.ndarray, k: int) -> np.ndarray:
    return hashes ^ np.uint64((0x9E3779B97F4A7C15 * k) & ((1 << 64) - 1))


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word number, feature) of all features of lower-case texts."""
    words, bounds, buffer, starts, ends = words_of(texts, BREAK)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    place = np.arange(len(words))
    every = [(text, place, words)]
    for k, size in enumerate(PREFIXES, 1):
        long = ends - starts > size
        begin = starts[long]
        every.append((text[long], place[long], _salted(span_hashes(buffer, begin, begin + size), k)))
    return tuple(np.concatenate([e[i] for e in every]) for i in range(3))


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def _word_features(word: str) -> np.ndarray:
    return features_of([plain(word)])[2]


class Swaps:
    """For each identity term the features it adds and those of the term that replaces it."""

    def __init__(self, terms: dict[str, tuple[str, ...]]):
        self.pairs = [
            (_word_features(a), _word_features(b))
            for kind in terms.values() for a, b in zip(kind, (*kind[1:], kind[0]))
        ]
        self.words = np.array([a[0] for a, _ in self.pairs], dtype=np.uint64)
        self.all = np.unique(np.concatenate([a for a, _ in self.pairs])) if self.pairs else self.words


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.known):
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[self.known >> np.uint64(48)] = True
            for first, last in batches(texts):
                text, _, feature = features_of(texts[first:last])
                some = maybe[feature >> np.uint64(48)]
                text, feature = text[some], feature[some]
                at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
                there = self.known[at] == feature
                pairs = np.unique(text[there] * len(self.known) + at[there])
                np.add.at(z, first + pairs // len(self.known), self.weights[pairs % len(self.known)])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _pairs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, feature) pairs, some texts at a time."""
    for first, last in batches(texts):
        t, _, f = features_of(texts[first:last])
        order = np.lexsort((f, t))
        t, f = t[order], f[order]
        if len(t):
            new = np.append(True, (t[1:] != t[:-1]) | (f[1:] != f[:-1]))
            yield t[new] + first, f[new]


def _summed(feature: np.ndarray, toxic: np.ndarray, n: np.ndarray):
    """Totals of equal features."""
    order = np.argsort(feature)
    feature = feature[order]
    first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
    return feature[first], np.add.reduceat(toxic[order], first), np.add.reduceat(n[order], first)


def fit_texts(texts: list[str], toxic: list[int], terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS,
              penalty: float = PENALTY) -> Model:
    """Fit on texts and 0/1 labels. With one label only, or no text, the score is a constant."""
    y = np.array(toxic, dtype=np.float64)
    rate = (y.sum() + 1) / (len(y) + 10)
    bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), bias)
    plain_texts = [plain(t) for t in texts]
    swaps = Swaps(terms)
    known = _associated(plain_texts, y, swaps.all)
    if not len(known):
        return Model(known, np.zeros(0), bias)
    rows, columns = [], []
    for text, feature in _pairs(plain_texts):
        at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
        there = known[at] == feature
        rows.append(text[there])
        columns.append(at[there])
    text, column = np.concatenate(rows), np.concatenate(columns)
    twin, old, new = _twins(text, column, known, swaps)
    return Model(known, *_descend(text, column, y, len(known), bias, (twin, old, new), penalty))


def _associated(texts: list[bytes], y: np.ndarray, always: np.ndarray) -> np.ndarray:
    """The features that tell most about the label, and the identity terms that occur."""
    parts, size = [], 0
    for text, feature in _pairs(texts):
        parts.append(_summed(feature, y[text], np.ones(len(text))))
        size += len(parts[-1][0])
        if size > 2_000_000:  # totals so far, so that memory follows the distinct features
            parts = [_summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))]
            size = 0
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    distinct, toxic, n = _summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
    expected = n * y.mean()
    surprise = (toxic - expected) ** 2 / (expected * (1 - n / (len(y) + 1)) + 1)
    surprise[n < LEAST_TEXTS] = -1
    best = np.argsort(-surprise, kind="stable")[:FEATURES]
    best = distinct[best[surprise[best] > 4]]
    return np.union1d(best, np.intersect1d(always, distinct))


def _twins(text: np.ndarray, column: np.ndarray, known: np.ndarray, swaps: Swaps):
    """(text, column, +1 or -1) of what changes when the identity terms of texts are swapped."""
    removed, added = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def place(features: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, features), len(known) - 1)
        return at[known[at] == features]

    for own, other in swaps.pairs:
        term = place(own[:1])
        if not len(term):
            continue
        holders = text[column == term[0]] * len(known)
        for where, keys in ((place(own), removed), (place(other), added)):
            keys.append((holders[:, None] + where).ravel())
    # forms of one word share beginnings: a text loses or gets a feature once
    gone, fresh = np.unique(np.concatenate(removed)), np.unique(np.concatenate(added))
    lost = np.setdiff1d(gone, fresh, assume_unique=True)
    got = np.setdiff1d(fresh, text * len(known) + column)
    changed = np.concatenate([lost, got])
    return changed // len(known), changed % len(known), np.repeat([-1.0, 1.0], [len(lost), len(got)])


def _descend(text, column, y, size, bias, twins, penalty) -> tuple[np.ndarray, float]:
    """Adam on the mean loss, the squared twin differences and a small decay."""
    twin, changed, sign = twins
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = bias
    for step in range(1, STEPS + 1):
        z = w[-1] + np.bincount(text, weights=w[column], minlength=len(y))
        wrong = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = np.zeros(size + 1)
        g[:-1] = np.bincount(column, weights=wrong[text], minlength=size) + DECAY * w[:-1]
        g[-1] = wrong.sum()
        if len(twin):
            moved = np.bincount(twin, weights=sign * w[changed], minlength=len(y))
            g[:-1] += 2 * penalty / len(np.unique(twin)) * np.bincount(
                changed, weights=sign * moved[twin], minlength=size
            )
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        rate = 0.1 if step < 0.7 * STEPS else 0.02
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, label_column: str = "toxic", text_column: str = "text",
        sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Fit on at most ``sample`` rows that have a text and a label 0 or 1, chosen by a hash
    of the text, so that equal tables give equal models."""
    rows = pick(labelled, **{label_column: "int", text_column: "string"}).toDF("toxic", "text")
    known = rows.where("toxic in (0, 1) and text is not null")
    picked = bounded_sample(known.withColumn("h", F.xxhash64("text", "toxic")), "h", sample)
    return fit_texts([r["text"] for r in picked], [r["toxic"] for r in picked], penalty=penalty)


def fit_by_id(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic",
              text_column: str = "text", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Fit on the texts of at most ``sample`` labelled ids.

    Ids are chosen from ``labels`` alone, those with the smallest hashes; texts are looked up in
    one scan of ``docs`` against that bounded list, so no text is shuffled. An id with several
    labels has the highest. Of several documents with one id, the text with the smallest hash
    counts; equal texts with equal labels count once. Null ids, other labels, ids
    without a document and null texts are left out.
    """
    known = pick(labels, **{id_column: "long", label_column: "int"}).toDF("row_id", "toxic").where(
        "row_id is not null and toxic in (0, 1)"
    ).groupBy("row_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("row_id"), "row_id").limit(sample)
    rows = pick(docs, **{id_column: "long", text_column: "string"}).toDF("row_id", "text").where("text is not null")
    found = rows.join(F.broadcast(chosen), "row_id").withColumn("h", F.xxhash64("text"))
    firsts = found.groupBy("row_id").agg(F.min(F.struct("h", "text", "toxic")).alias("first")).select("first.*")
    picked = {(r["text"], r["toxic"]): r["h"] for r in firsts.collect()}
    ordered = sorted(picked, key=lambda k: (picked[k], k))
    return fit_texts([t for t, _ in ordered], [y for _, y in ordered], penalty=penalty)


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    """Some texts at a time, so that memory follows a batch of them and not of rows."""
    parts = [model.scores([t.translate(LOWER) for t in texts]) for *_, texts in text_batches(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _scored(model: Model):
    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(_scores(model, part.column(1)))], names=["doc_id", "score"]
            )

    return scored


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row. Null and empty texts get the score of a text
    without features. Repeated rows repeat, null ids come back as null."""
    rows = pick(docs, **{id_column: "long", text_column: "string"}).toDF("doc_id", "text")
    return rows.mapInArrow(freed(_scored(model)), "doc_id long, score double").select(
        "doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they are.

    Null and empty texts have the score of a text without features, repeated rows stay or go
    together, and no other column is looked at. An empty table stays empty.
    """
    at = position(docs.columns, text_column)

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(_scores(model, part.column(at)) < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)
