"""Token ids as binary files, with a minimal perfect hash index from document to place.

Layout of a folder: ``shard-N.bin`` holds the ids of consecutive documents in ascending
order of their ids, each document closed by an end id, as little-endian unsigned
integers of two bytes (four for vocabularies beyond 65 536). ``index-N.bin`` maps the
keys of one hash bucket to shard, place and length. The key of a document is its id
and, where ids repeat, the number of its copy in file order. A look-up reads the bucket's
index once; each key then costs one slot and one range of a shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discourse_spark.llm import files, perfect_hash
from discourse_spark.llm.common import NO_ID, id_or_last, pick, ship, written
from discourse_spark.session import shared_folder

END_ID = 0
SHARD_BYTES = 32 << 20  # text bytes of a shard
INDEX_KEYS = 50_000  # keys of one index file


def _written_shards(folder: str, path: str):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from discourse_spark.llm.tokens import encoder

        encode = encoder(path)
        shard = TaskContext.get().partitionId()
        entries: list[pd.DataFrame] = []

        def payload():
            at, last, copy = 0, None, 0
            for part in parts:
                ids = [np.append(encode.encode(t), encode.kind.type(END_ID)).astype(encode.kind) for t in part["text"]]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                copies = []
                for row_id in part["row_id"].tolist():
                    copy = copy + 1 if row_id == last else 0
                    last = row_id
                    copies.append(copy)
                entries.append(pd.DataFrame({
                    "row_id": part["row_id"], "copy": copies, "shard": shard,
                    "place": at + np.cumsum(sizes) - sizes, "n_tokens": sizes,
                }))
                at += int(sizes.sum())
                yield b"".join(x.tobytes() for x in ids)

        first = next(made := payload(), None)
        if first is not None:
            def every():
                yield first
                yield from made

            files.put(folder, f"shard-{shard}.bin", every())
        yield from entries

    return write


def _written_index(folder: str):
    def write(key, part: pd.DataFrame) -> pd.DataFrame:
        hashes = perfect_hash.key_hashes(part["row_id"].to_numpy(), part["copy"].to_numpy())
        files.put(folder, f"index-{key[0]}.bin", perfect_hash.pack(
            hashes, [part[c].to_numpy() for c in ("shard", "place", "n_tokens")]
        ))
        return pd.DataFrame({"bucket": [key[0]], "keys": [len(part)]})

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id",
                 text_column: str = "text", folder: str | None = None) -> tuple[str, DataFrame, int]:
    """Write shards and index; returns the folder, the keys (row_id, copy) and the number of buckets.

    A null text counts as empty and has its end id alone. Null ids come last.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = pick(docs, **{id_column: "long", text_column: "string"}).toDF("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = written(
        rows.select(id_or_last().alias("row_id"), "text")
        .repartitionByRange(max(1, -(-size // SHARD_BYTES)), "row_id")
        # texts too: another attempt writes the documents of one id in the same order
        .sortWithinPartitions("row_id", "text")
        .mapInPandas(_written_shards(folder, tokenizer_path),
                     "row_id long, copy long, shard long, place long, n_tokens long"),
        "entries",
    )
    buckets = max(1, -(-entries.count() // INDEX_KEYS))
    bucket = F.pmod(F.xxhash64("row_id", "copy"), F.lit(buckets)).alias("bucket")
    entries.select("*", bucket).groupBy("bucket").applyInPandas(
        _written_index(folder), "bucket long, keys long"
    ).agg(F.sum("keys")).first()
    return folder, entries, buckets


def _found(folder: str):
    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, index = None, None
        for part in parts:
            for bucket, own in part.groupby("bucket", sort=True):
                if bucket != name:
                    name, index = bucket, perfect_hash.Index(files.get(folder, f"index-{bucket}.bin"))
                slot = index.find(perfect_hash.key_hashes(own["row_id"].to_numpy(), own["copy"].to_numpy()))
                own, slot = own[slot >= 0], slot[slot >= 0]
                yield pd.DataFrame({
                    "row_id": own["row_id"], "copy": own["copy"],
                    **{c: index.columns[k][slot] for k, c in enumerate(("shard", "place", "n_tokens"))},
                })

    return found


def look_up(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(row_id, copy, shard, place, n_tokens) of the keys (row_id, copy) that are there."""
    bucket = F.pmod(F.xxhash64("row_id", "copy"), F.lit(buckets)).alias("bucket")
    return (
        keys.select("row_id", "copy", bucket)
        .repartition("bucket").sortWithinPartitions("bucket")
        .mapInPandas(_found(folder), "row_id long, copy long, shard long, place long, n_tokens long")
    )


def _digested(folder: str, kind: str):
    width = np.dtype(kind).itemsize

    def digested(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = files.Reader(folder)
        for part in parts:
            crcs = []
            for shard, place, n in zip(part["shard"].tolist(), part["place"].tolist(), part["n_tokens"].tolist()):
                data = reader.read(f"shard-{shard}.bin", place * width, n * width)
                crcs.append(zlib.crc32(np.frombuffer(data, kind).astype("<u4").tobytes()))
            yield part[["row_id", "shard", "place", "n_tokens"]].assign(ids_crc32=crcs)
        reader.close()

    return digested


def read_digests(placed: DataFrame, folder: str, kind: str) -> DataFrame:
    """(row_id, shard, place, n_tokens, ids_crc32) read back from the shards, in file order."""
    return (
        placed.repartition("shard").sortWithinPartitions("shard", "place")
        .mapInPandas(_digested(folder, kind),
                     "row_id long, shard long, place long, n_tokens long, ids_crc32 long")
    )


def id_kind(tokenizer_path: str) -> str:
    from discourse_spark.llm.tokens import encoder

    return encoder(tokenizer_path).kind.str


def round_trip(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): every document written, found by its key and read back."""
    folder, entries, buckets = write_tokens(docs, tokenizer_path, id_column, text_column)
    sizes = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    begins, total = {}, 0  # one number per shard file
    for r in sizes:
        begins[r["shard"]] = total
        total += r["n"]
    spark: SparkSession = docs.sparkSession
    starts = spark.createDataFrame(list(begins.items()), "shard long, begin long")
    found = look_up(entries.select("row_id", "copy"), folder, buckets)
    return read_digests(found, folder, id_kind(tokenizer_path)).join(starts, "shard").select(
        F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("doc_id"),
        (F.col("begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32",
    )
