"""Near-duplicate documents by min-max hashing and banding.

Under each permutation of the shingle hashes both the smallest and the largest value
are kept, so 32 permutations give 64 signature values for half the hash work, with
lower variance. Bands of three values propose partners: a pair at similarity 0.75
shares no band with probability (1 - 0.75^3)^21, about 1e-5, and every proposed link
is confirmed on the full shingle sets.

No pair list of a group is ever made:

1. Documents with the same words fall together first; one of them stands for all.
2. In each band bucket every member is compared with one centre only: the member whose
   bands are shared most, as those of an original are among its edited copies.
3. Where a bucket still holds several components, its members are compared in blocks, by
   signature first and then on their sets. A block returns a spanning forest of its
   links, and a pair is looked at in the first bucket that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.llm.common import NO_ID, freed, id_or_last, pick, plain_columns, position, text_batches, written
from discourse_spark.llm.graph import components
from discourse_spark.llm.words import LOWER, batches, mix, shingles_of, whole_hash, words_of

WIDTH = 5
PERMUTATIONS = 32
ROWS = 3  # signature values in a band
BANDS = 2 * PERMUTATIONS // ROWS
NUMERATOR, DENOMINATOR = 3, 4  # similarity of a link: at least 0.75
BLOCK = 512
# A pair of similarity s agrees in about 64 s values, with a deviation below 0.055:
# at 0.75 less than 0.5 is 4.5 deviations away.
LOOKS_ALIKE = 0.5

_random = np.random.default_rng(7)
FLIPS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain_words(text: str | None) -> bytes:
    """The words of a text in lower case (A-Z only), joined by single spaces."""
    return _plain((text or "").encode("utf-8", "surrogatepass"))


def _plain(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split())


def shingle_sets(plain: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than WIDTH are one shingle."""
    for first, last in batches(plain):
        hashes, bounds, *_ = words_of(plain[first:last])
        shingles, at = shingles_of(hashes, bounds, WIDTH)
        for i in range(last - first):
            own = shingles[at[i] : at[i + 1]]
            if not len(own) and bounds[i + 1] > bounds[i]:
                own = np.array([whole_hash(hashes[bounds[i] : bounds[i + 1]])], dtype=np.uint64)
            yield np.unique(own)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under each permutation, side by side."""
    values = np.empty(2 * PERMUTATIONS, dtype=np.uint64)
    for k in range(PERMUTATIONS):
        permuted = (shingles ^ FLIPS[k]) * FACTORS[k]
        values[2 * k], values[2 * k + 1] = permuted.min(), permuted.max()
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature (the rows), its number included."""
    parts = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    h = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(parts), axis=0)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x100000001B3) + parts[:, :, j])
    return h.view(np.int64)


def _digest(plain: bytes) -> bytes | None:
    return hashlib.blake2b(plain, digest_size=16).digest() if plain else None


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (row_id, text_hash, text). Only some texts and their sets are held at a time."""
    for part in parts:
        for first, last, texts in text_batches(part.column(2)):
            plain = [_plain(t) for t in texts]
            n, keys = [], []
            for own in shingle_sets(plain):
                n.append(len(own))
                keys.append(band_keys(signature(own)[None, :])[0] if len(own) else np.zeros(0, dtype=np.int64))
            offsets = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays([
                part.column(0).slice(first, last - first), part.column(1).slice(first, last - first),
                pa.array([_digest(p) for p in plain], pa.binary()), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys))),
            ], names=["row_id", "text_hash", "digest", "n_shingles", "keys"])


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (digest, text)."""
    for part in parts:
        for first, last, texts in text_batches(part.column(1)):
            plain = [_plain(t) for t in texts]
            digests = part.column(0).slice(first, last - first).to_pylist()
            right = [(p, d) for p, d in zip(plain, digests) if _digest(p) == d]
            shingles, signatures = [], []
            for own in shingle_sets([p for p, _ in right]):
                shingles.append(own.tobytes())
                signatures.append(signature(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for _, d in right], pa.binary()), pa.array(shingles, pa.binary()),
                 pa.array(signatures, pa.binary())], names=["digest", "shingles", "signature"],
            )


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two distinct-value arrays reach the similarity of a link."""
    small, large = sorted((len(a), len(b)))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _confirm(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        sets_a = [np.frombuffer(s, dtype=np.uint64) for s in part["set_a"]]
        sets_b = [np.frombuffer(s, dtype=np.uint64) for s in part["set_b"]]
        yes = [linked(a, b) for a, b in zip(sets_a, sets_b)]
        yield part.loc[yes, ["a", "b"]]


def _forest(key, members: pd.DataFrame) -> pd.DataFrame:
    """Links within one pair of blocks that join components, as few as that takes."""
    bucket, i, j = key
    signed = np.frombuffer(b"".join(members["signature"]), dtype=np.uint64).reshape(len(members), -1)
    keys = band_keys(signed)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in members["shingles"]]
    digests, block = members["digest"].to_numpy(), members["block"].to_numpy()
    label = np.unique(members["component"].to_numpy(), return_inverse=True)[1]
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links = []
    for x in one:
        others = two[label[two] != label[x]]
        if i == j:
            others = others[others > x]
        shared = keys[others] == keys[x]
        first = keys[x][shared.argmax(axis=1)] == bucket
        same = (signed[others] == signed[x]).sum(axis=1)
        near = first & (same >= LOOKS_ALIKE * signed.shape[1])
        for y in others[near][np.argsort(-same[near], kind="stable")].tolist():
            if label[x] != label[y] and linked(sets[x], sets[y]):
                label[label == label[y]] = label[x]
                links.append((digests[x], digests[y]))
    return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]})


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    ``component_id`` is the smallest id reachable through links, ``kept`` tells whether
    it is the document's own. Null, empty and blank texts have no shingles and link
    with nothing. Repeated rows get the same answer each. A null id is larger than any
    other; it comes back as null, and is kept unless it links with a known id.
    """
    hashed, labels = _labelled(docs, id_column, text_column)
    return (
        hashed.join(labels, "digest", "left")
        .select(
            F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("doc_id"),
            "n_shingles",
            F.coalesce("component_id", "row_id").alias("component"),
        )
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
            (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("component")).alias("kept"),
        )
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, the one with the smallest id, and
    one of rows that repeat it. Texts without words all stay."""
    names = docs.columns
    id_at, text_at = position(names, id_column), position(names, text_column)
    hashed, labels = _labelled(docs, id_column, text_column)
    rows = plain_columns(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("digest", T.BinaryType())])

    def digested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests = [
                _digest(_plain(t)) for *_, texts in text_batches(part.column(text_at)) for t in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(digests, pa.binary())], names=[*part.schema.names, "digest"]
            )

    keyed = rows.mapInArrow(digested, schema).withColumn(
        "row_id", F.coalesce(F.col(f"_{id_at}").cast("long"), F.lit(NO_ID))
    )
    gone = hashed.join(labels, "digest").where("row_id <> component_id").select("row_id", "digest").distinct()
    same = Window.partitionBy("row_id", "digest").orderBy("row_id")
    return (
        keyed.join(gone, ["row_id", "digest"], "left_anti")
        .withColumn("copy", F.row_number().over(same)).where("copy = 1 or digest is null")
        .select(*[f"_{i}" for i in range(len(names))]).toDF(*names)
    )


def _labelled(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, text_hash, digest, n_shingles, keys) of each row, and (digest, component_id)."""
    rows = pick(docs, **{id_column: "long", text_column: "string"}).toDF("doc_id", "text")
    rows = rows.select(id_or_last().alias("row_id"), "text", F.xxhash64("text").alias("text_hash"))
    hashed = written(
        rows.select("row_id", "text_hash", "text").mapInArrow(
            freed(_hashed), "row_id long, text_hash long, digest binary, n_shingles long, keys array<long>"
        ),
        "hashed",
    )
    classes = written(
        hashed.where("n_shingles > 0").groupBy("digest").agg(
            F.min(F.struct("row_id", "text_hash")).alias("at"), F.first("keys").alias("keys")
        ).select("digest", "at.*", "keys"),
        "classes",
    )
    return hashed, written(_labels(rows, classes), "labels")


def _labels(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, component_id) of each class of equal word sequences."""
    bands = classes.select("digest", F.explode("keys").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(bands.join(sizes, "key"), "shared")
    scores = shared.groupBy("digest").agg(F.sum("n").alias("score"))
    scored = written(shared.join(scores, "digest").select("key", "digest", "score"), "scored")
    centres = scored.groupBy("key").agg(F.max(F.struct("score", "digest"))["digest"].alias("center"))
    members = written(scored.join(centres, "key").where("digest <> center").drop("score"), "members")
    star = members.select(F.col("center").alias("a"), F.col("digest").alias("b")).distinct()
    involved = members.select("digest").union(members.select("center")).distinct()
    sets = written(
        _texts(rows, classes.join(involved, "digest", "left_semi"))
        .mapInArrow(freed(_sets), "digest binary, shingles binary, signature binary")
        .dropDuplicates(["digest"]),
        "sets",
    )
    first = written(_confirmed(star, sets), "links")
    stars = written(components(first), "stars")
    second = _between(members, sets, stars)
    # what is joined already goes in as stars, which no round has to change
    found = components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).union(second))
    labelled = classes.select("digest", "row_id").join(
        found, F.col("digest") == F.col("id"), "left"
    ).select("digest", "row_id", F.coalesce("component", "digest").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("row_id").alias("component_id"))
    return labelled.join(smallest, "component").select("digest", "component_id")


def _texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(digest, text) of classes: the rows that have both the id and the text of their first
    row, as any number of rows may have its id, null among them."""
    return classes.select("digest", "row_id", "text_hash").join(
        rows, ["row_id", "text_hash"]
    ).select("digest", "text")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    whole = sets.select("digest", "shingles")
    return (
        pairs.join(whole.toDF("a", "set_a"), "a").join(whole.toDF("b", "set_b"), "b")
        .select("a", "b", "set_a", "set_b").mapInPandas(_confirm, "a binary, b binary")
    )


def _between(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links among bucket members, other than the bucket's centre, that are still in
    different components. Block pairs bound what one task holds."""
    placed = members.select("key", "digest").join(
        found, F.col("digest") == F.col("id"), "left"
    ).select("key", "digest", F.coalesce("component", "digest").alias("component"))
    placed = written(placed, "placed")
    open_keys = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
    ).where("low <> high").select("key", "blocks")
    blocked = (
        placed.join(open_keys, "key")
        .withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "digest", "component")
        .join(sets, "digest")
    )
    return blocked.groupBy("key", "i", "j").applyInPandas(_forest, "a binary, b binary")
