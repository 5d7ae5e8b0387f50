"""CSV records with quoted line breaks, found by many tasks in one large file.

A chunk of lines read alone does not tell whether it starts inside quotes. It does tell how it
ends in either case, and such effects compose: taken in file order they give the state at the
start of every chunk. Lines before a chunk's first record go to the chunk that opened them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.session import materialize

CHUNK_BYTES = 1 << 18
_QUOTE, _FEED, _RETURN, _COMMA = b'"'[0], b"\n"[0], b"\r"[0], b","[0]
_BLANK = (b"", b"\r")
_MARK = b"\xef\xbb\xbf"  # may stand before the first field of a file
_KEY = ["file", "block", "chunk"]


def open_after_lines(text: bytes, is_open: bool, known: np.ndarray | None = None) -> np.ndarray:
    """Per line of ``text``, which ends with a line feed: is a quoted field open after it?

    ``known`` are the answers for the other start; from where both agree they are the same.
    """
    codes = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(codes == _QUOTE)
    if _regular(codes, quotes, is_open):
        return (np.searchsorted(quotes, np.flatnonzero(codes == _FEED)) + is_open) % 2 == 1
    states = []
    for i, line in enumerate(text.split(b"\n")[:-1]):
        is_open = _open_after(line, is_open)
        if known is not None and known[i] == is_open:
            return np.concatenate([np.array(states, bool), known[i:]])
        states.append(is_open)
    return np.array(states, bool)


def _regular(codes: np.ndarray, quotes: np.ndarray, is_open: bool) -> bool:
    """Do quotes open fields only where these start, and close them only where they end?"""
    opening, closing = quotes[int(is_open)::2], quotes[1 - int(is_open)::2]
    before = codes[opening[opening > 0] - 1]
    after = codes[closing + 1]  # the last byte is a line feed
    starts = np.isin(before, (_COMMA, _FEED, _QUOTE))
    return bool(starts.all() and np.isin(after, (_COMMA, _FEED, _RETURN, _QUOTE)).all())


def _open_after(line: bytes, is_open: bool) -> bool:
    """The same for one line with any quotes: those within a plain field are text, and after
    one that should have ended a field the rest is plain up to the next comma."""
    parts = line.split(b'"')
    if len(parts) == 1:
        return is_open
    may_open = parts[0] in (b"", _MARK) or parts[0].endswith(b",")
    ended = False  # by the quote just before, which a further one would double
    for part in parts[1:]:
        if is_open:
            is_open, ended = False, not part
            may_open = part.endswith(b",")
        elif ended or may_open:
            is_open, ended = True, False
        else:
            may_open = part.endswith(b",")
    return is_open


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task as chunks of about ``CHUNK_BYTES``, none across two ranges of a file."""
    of, number, lines, size = None, 0, [], 0

    def chunk() -> pa.RecordBatch:
        text = b"\n".join(lines) + b"\n"
        known = open_after_lines(text, False)
        opened = open_after_lines(text, True, known)
        feeds = np.flatnonzero(np.frombuffer(text, np.uint8) == _FEED)
        closed = int(feeds[opened.argmin()]) + 1 if not opened.all() else len(text)
        filled = bool(text.removeprefix(_MARK).strip(b"\r\n"))
        values = (*of, number, text, bool(known[-1]), bool(opened[-1]), closed, len(text), filled)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], field.type) for v, field in zip(values, _CHUNKS)], schema=_CHUNKS
        )

    for batch in batches:
        for file, block, values in _ranges(batch):
            if lines and (file, block) != of:
                yield chunk()
                number, lines, size = number + 1, [], 0
            of = (file, block)
            for value in values:
                lines.append(value)
                size += len(value) + 1
                if size >= CHUNK_BYTES:
                    yield chunk()
                    number, lines, size = number + 1, [], 0
    if lines:
        yield chunk()


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes]]]:
    """Runs of lines of one range of a file. Few batches have several."""
    files, blocks = (column.dictionary_encode() for column in batch.columns[:2])
    code = np.asarray(files.indices, np.int64) * len(blocks.dictionary) + np.asarray(blocks.indices)
    cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            values = batch.column(2).slice(start, end - start).to_pylist()
            yield files[start].as_py(), blocks[start].as_py(), values


_CHUNKS = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("text", pa.binary()),
    ("from_closed", pa.bool_()), ("from_open", pa.bool_()), ("closed", pa.int64()), ("size", pa.int64()),
    ("filled", pa.bool_()),
])
_CHUNKS_DDL = (
    "file string, block long, chunk long, text binary, from_closed boolean, from_open boolean, "
    "closed long, size long, filled boolean"
)


def _starts(chunks: DataFrame) -> DataFrame:
    """Per chunk: bytes before its first record, the chunk they belong to, and whether its first
    record is the file's header. Blank lines leave a file closed, so that is a filled chunk's."""
    in_file = Window.partitionBy("file").orderBy("block", "chunk")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    sofar = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = F.col("from_closed") & ~F.col("from_open")
    sets = F.col("from_closed") == F.col("from_open")
    last_set = F.last(
        F.when(sets, F.struct(F.col("from_open").alias("open"), F.col("swaps").alias("swaps"))), ignorenulls=True
    ).over(before)
    swaps = F.coalesce(F.lag("swaps").over(in_file), F.lit(0)) - F.coalesce(F.col("set.swaps"), F.lit(0))
    is_open = F.coalesce(F.col("set.open"), F.lit(False)) != (swaps % 2 == 1)
    key = F.struct("block", "chunk")
    stated = (
        chunks.select(*_KEY, "from_closed", "from_open", "closed", "size", "filled")
        .withColumn("swaps", F.sum(swap.cast("long")).over(sofar)).withColumn("set", last_set)
        .withColumn("head", F.when(is_open, F.col("closed")).otherwise(0))
    )
    return stated.select(
        *_KEY, "head", (F.col("head") < F.col("size")).alias("owns"),
        F.last(F.when(F.col("head") < F.col("size"), key), ignorenulls=True).over(before).alias("owner"),
        (F.min(F.when(F.col("filled"), key)).over(Window.partitionBy("file")) == key).alias("header"),
    )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            text = row["body"] + b"".join(tail["text"] for tail in row["tails"] or [])
            ends = np.flatnonzero(np.frombuffer(text, np.uint8) == _FEED)[~open_after_lines(text, False)]
            cuts = [0, *(ends + 1).tolist()]
            if cuts[-1] < len(text):  # no quote closes the last record of the file
                cuts.append(len(text))
            found = [text[a:b - 1] for a, b in zip(cuts, cuts[1:])]
            found = [r.removesuffix(b"\r") for r in found if r.removeprefix(_MARK) not in _BLANK]
            if row["header"] and found and b"\r" in re.sub(rb'"[^"]*"', b"", found[0]):
                raise ValueError(f"carriage returns alone end the lines of {row['file']}")
            yield pa.RecordBatch.from_arrays([
                pa.array([row["file"]] * len(found), pa.string()),
                pa.array(found, pa.binary()),
                pa.array([bool(row["header"]) and i == 0 for i in range(len(found))], pa.bool_()),
            ], names=["file", "record", "header"])


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of CSV files as text: ``file``, ``record`` and whether it is the file's ``header``.

    Lines end with a line feed; a carriage return before it is dropped at the end of a record.
    Blank lines between records are left out. An unclosed quote makes the rest of its file one
    record. Files whose lines end with a carriage return alone are an error. Chunks are written
    once, so that all passes see the same; what is shuffled of texts are records across chunks,
    and chunks only where the planner can't send their states to them.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    chunks = materialize(read.mapInArrow(_chunks, _CHUNKS_DDL), "chunks", row_group_bytes=8 << 20)
    starts = materialize(_starts(chunks), "starts")
    heads = chunks.join(starts.where(F.col("head") > 0).select(*_KEY, "head", "owner"), _KEY)
    tails = heads.groupBy(
        "file", F.col("owner.block").alias("block"), F.col("owner.chunk").alias("chunk")
    ).agg(F.sort_array(F.collect_list(F.struct("block", "chunk", _part(F.lit(1), F.col("head"))))).alias("tails"))
    owning = starts.where("owns").select(*_KEY, "head", "header")
    body = _part(F.col("head") + 1, F.col("size") - F.col("head")).alias("body")
    whole = chunks.join(owning, _KEY).select(*_KEY, body, "header").join(tails, _KEY, "left")
    return whole.select("file", "body", "tails", "header").mapInArrow(_records, "file string, record binary, header boolean").withColumn(
        "record", F.col("record").cast("string")
    )


def _part(start: Column, length: Column) -> Column:
    return F.substring(F.col("text"), start, length).alias("text")


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` from ``record``, by the engine's own parser."""
    fields = ", ".join(f"_{i} {field.dataType.simpleString()}" for i, field in enumerate(schema.fields))
    parsed = F.from_csv("record", fields, {"multiLine": "true", "escape": '"'})
    return records.select(parsed.alias("r")).select("r.*").toDF(*schema.names)
