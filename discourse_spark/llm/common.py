"""Helpers shared by the operators: columns by name, written intermediate tables, sizes.

Rules that hold for every operator here:

- A null text counts as an empty one, unless an operator says otherwise.
- A null id counts as larger than every other id, and comes back as null.
- Columns are taken by exact name first, then without regard to case, so further
  columns with clashing names do no harm.
- Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, never to
  executor storage, so lost executors cost a recomputation at most.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discourse_spark.session import shared_folder

NO_ID = (1 << 63) - 1  # stands for a null id while ids are compared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast to the given types."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[
        F.col(f"_{position(names, name)}").cast(kind).alias(name) for name, kind in wanted.items()
    ])


def position(names: list[str], wanted: str) -> int:
    if wanted in names:
        return names.index(wanted)
    lowered = [n.lower() for n in names]
    if wanted.lower() in lowered:
        return lowered.index(wanted.lower())
    raise ValueError(f"no column {wanted}; there are {', '.join(names)}")


def plain_columns(df: DataFrame) -> DataFrame:
    """Columns named ``_0``, ``_1`` ... so that helper columns can never clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Readers prune columns and push filters; the files survive lost executors and go
    when the application ends, or earlier through ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _file_system(df.sparkSession, folder).delete(_path(df.sparkSession, folder), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the workers as a file, once per application.

    Functions are pickled by value, which is enough for most. Those that keep caches of
    words from task to task import their module instead, and so need it there.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        import discourse_spark

        root = os.path.dirname(os.path.dirname(os.path.abspath(discourse_spark.__file__)))
        with tempfile.TemporaryDirectory() as folder:
            archive = shutil.make_archive(f"{folder}/discourse_spark", "zip", root, "discourse_spark")
            kept = f"{tempfile.gettempdir()}/discourse_spark-{app}.zip"
            shutil.copy(archive, kept)
        spark.sparkContext.addPyFile(kept)
        _shipped.add(app)


def bounded_sample(rows: DataFrame, key: str, most: int) -> list:
    """At most ``most`` rows with different keys, those with the smallest keys, on the driver.

    Keys alone decide first, so tasks never send more rows than are wanted.
    """
    keys = rows.select(key).distinct().orderBy(key).limit(most)
    cut = keys.agg(F.max(key)).first()[0]
    if cut is None:
        return []
    picked = rows.where(F.col(key) <= cut).dropDuplicates([key]).limit(most).collect()
    return sorted(picked, key=lambda r: r[key])


def text_batches(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row behind the last, texts as UTF-8 bytes) of a text column, with about ``most``
    bytes at a time; a longer text is alone. Nulls are empty. Only one batch is copied at once."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    until = np.cumsum(sizes + 1)
    first = 0
    while first < len(sizes):
        before = until[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(until, before + most, side="right")))
        part = column.slice(first, last - first).cast(pa.binary())
        yield first, last, [t or b"" for t in part.to_pylist()]
        first = last
    pa.default_memory_pool().release_unused()  # workers live on into later stages


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over batches, which gives back memory when a task begins and ends."""
    def run(parts: Iterator) -> Iterator:
        give_back()
        yield from function(parts)
        give_back()

    return run


def id_or_last(column: str = "doc_id"):
    """The id, or the largest possible one for null."""
    return F.coalesce(F.col(column), F.lit(NO_ID))
