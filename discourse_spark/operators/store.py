"""A keyed table that is added to in commits, and results per text kept in it.

What is written counts once a manifest names it, so a write that was killed leaves nothing
behind that a reader sees, and one that is repeated adds nothing. Two writers cannot commit
the same version: the later one leaves out what the earlier has added and tries again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.operators.skew import salted_join
from discourse_spark.session import materialize, shared_folder

BUCKETS = 64


class KeyedStore:
    """Rows by a unique ``key`` in folders of hash buckets under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _file(self, name: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def _manifests(self) -> list[str]:
        system, folder = self._file("manifest")
        if not system.exists(folder):
            return []
        return sorted(n for s in system.listStatus(folder) if (n := s.getPath().getName()).startswith("v"))

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        names = self._manifests()
        return int(names[-1][1:]) if names else 0

    def _folders(self, version: int) -> list[str]:
        """Folders that the commits up to ``version`` name; one line each reaches the driver.

        A line without its end was cut off with its writer and names nothing.
        """
        if not version:
            return []
        names = [n for n in self._manifests() if int(n[1:]) <= version]
        lines = self.spark.read.text([f"{self.path}/manifest/{n}" for n in names]).collect()
        return sorted(line["value"][:-1] for line in lines if line["value"].endswith(";"))

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a version, the last by default, with ``_bucket``; None before the first."""
        folders = self._folders(self.version() if version is None else version)
        if not folders:
            return None
        return self._rows(folders)

    def _rows(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("_commit")

    def without_known(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of ``df`` whose key is not stored, with ``_bucket``, which both sides meet in."""
        known, df = self.read(version), self.bucketed(df)
        if known is None:
            return df
        return df.join(known.select("_bucket", self.key), ["_bucket", self.key], "left_anti")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """Stored rows of the distinct ``keys``. Few keys only read the buckets they lie in."""
        stored = self.read()
        if stored is None:
            raise ValueError(f"nothing is stored in {self.path}")
        wanted = self.bucketed(keys.select(self.key).distinct())
        return stored.join(wanted, ["_bucket", self.key], "left_semi").drop("_bucket")

    def add(self, df: DataFrame) -> int:
        """Add the rows whose key is new, one for each key, and return the version they are in."""
        version = self.version()
        new = self.without_known(df.where(F.col(self.key).isNotNull()), version)
        while True:
            folder = f"_commit=c{uuid.uuid4().hex}"
            new.dropDuplicates(["_bucket", self.key]).write.partitionBy("_bucket").parquet(
                f"{self.path}/data/{folder}"
            )
            system, written = self._file(f"data/{folder}")
            if not any(s.isDirectory() for s in system.listStatus(written)):
                return version
            if self._commit(version + 1, folder):
                return version + 1
            version = self.version()
            new = self.without_known(self._rows([folder]).drop("_bucket"), version)

    def _commit(self, version: int, folder: str) -> bool:
        """Create the manifest of a version unless there is one."""
        system, file = self._file(f"manifest/v{version:010d}")
        try:
            out = system.create(file, False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        try:
            out.write(bytearray(f"{folder};\n".encode()))
        finally:
            out.close()
        return True


def once_per_text(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame],
                  text_col: str = "clean_text", id_col: str = "post_id", ranges: int = 16,
                  tries: int = 1) -> DataFrame:
    """``df`` with the columns that ``compute`` adds to (``text_key``, ``text_col``), kept by content.

    Every distinct text without a stored result is computed once; a null text counts as empty.
    Texts are split into hash ranges that are computed and committed one by one. A range that
    fails does not hold up the others and is tried again alone, ``tries`` times in all; what
    fails then is raised at the end. A later call only computes what no commit holds.
    Results must not depend on the id. An edited text is a new one.
    """
    spark = df.sparkSession
    store = KeyedStore(spark, path, "text_key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = store.bucketed(df.select(F.md5(text).alias("text_key"), text.alias(text_col)))
    distinct = distinct.dropDuplicates(["_bucket", "text_key"])
    pending = f"{shared_folder(spark)}/pending-{uuid.uuid4().hex}"
    missing = store.without_known(distinct)
    missing.withColumn("_range", F.pmod("_bucket", F.lit(ranges))).write.partitionBy("_range").parquet(pending)
    schema = T.StructType([*missing.schema.fields, T.StructField("_range", T.IntegerType())])
    waiting = spark.read.schema(schema).parquet(pending)
    left = sorted(r["_range"] for r in waiting.select("_range").distinct().collect())
    failures: dict[int, Exception] = {}
    for _ in range(tries):
        failures = {}
        for part in left:
            rows = waiting.where(F.col("_range") == part).drop("_range", "_bucket")
            try:
                store.add(compute(rows).drop(text_col))
            except (Py4JJavaError, PySparkException) as error:
                failures[part] = error
        left = sorted(failures)
    if failures:
        raise RuntimeError(f"{len(failures)} of {ranges} ranges failed: {left}") from failures[left[0]]
    stored = store.read()
    if stored is None:  # there are no rows, only the columns of an empty computation
        fresh = compute(waiting.select("text_key", text_col)).drop("text_key", text_col)
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fresh.schema.fields})
    results = materialize(stored.drop("_bucket"), "per-text")
    taken = [c for c in results.columns if c != "text_key"]
    keyed = df.drop(*taken).withColumn("text_key", F.md5(text))
    return salted_join(keyed, results, "text_key", "left", id_col).select(
        *[c for c in df.columns if c not in taken], *taken
    )
