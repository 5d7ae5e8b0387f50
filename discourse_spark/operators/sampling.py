"""Deterministic sampling that never sorts a whole table or a whole stratum.

Rows carry a hash key. A histogram of key ranges per stratum (at most ``BUCKETS``
rows each, combined before the shuffle) tells which range holds the last row of
the quota. While that range holds many rows it is divided again. In the end,
rows below it are taken without a shuffle and only the rows inside it are
ranked, in ranges, so that even many rows with one key need no large task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.operators.ranks import with_running_total
from discourse_spark.session import materialize

BUCKETS = 4096
BORDER_ROWS = 100_000
KEY_SPACE = 1 << 40


def hash_key(seed: int, *columns: str) -> Column:
    """Pseudo-random key in ``[0, KEY_SPACE)``, stable across partitionings."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(KEY_SPACE))


class QuotaSplit:
    """Marks, in each stratum, the ``quota`` rows with the smallest hash keys.

    ``quotas`` maps a table (stratum, size) to one with an added ``quota`` column.
    Without ``stratum`` the whole table is one.
    """

    def __init__(self, df: DataFrame, stratum: Column | None,
                 quotas: Callable[[DataFrame], DataFrame], id_col: str = "post_id",
                 key: Column | None = None, key_space: int = KEY_SPACE, seed: int = 42,
                 border_rows: int = BORDER_ROWS) -> None:
        key = hash_key(seed, id_col) if key is None else key
        self._id = id_col
        self._single = stratum is None
        self._keyed = df.withColumns(
            {"_stratum": F.lit(0) if stratum is None else stratum, "_key": key.cast("long")}
        )
        self._width = -(-key_space // BUCKETS)
        counts = self._histogram(self._keyed, F.lit(0).cast("long"))
        sizes = counts.groupBy(F.col("_s").alias("stratum")).agg(F.sum("n").alias("size"))
        wanted = quotas(sizes).select(
            F.col("stratum").alias("_s"), F.col("quota").alias("_quota"), F.col("quota").alias("_take")
        )
        self._cuts = self._cut(counts, wanted)
        while self._width > 1 and (self._border_size() or 0) > border_rows:
            inside = self._placed().where(self._in_border())
            self._width = -(-self._width // BUCKETS)
            counts = self._histogram(inside, F.col("_low"))
            self._cuts = self._cut(counts, self._cuts.select("_s", "_quota", "_take"))

    def _histogram(self, rows: DataFrame, low: Column) -> DataFrame:
        """Rows per stratum and key range: (_s, _from, n), written once."""
        start = low + F.floor((F.col("_key") - low) / self._width) * self._width
        counts = rows.groupBy(F.col("_stratum").alias("_s"), start.alias("_from")).agg(
            F.count(F.lit(1)).alias("n")
        )
        return materialize(counts, "histogram")

    def _cut(self, counts: DataFrame, wanted: DataFrame) -> DataFrame:
        """One row per stratum: where the border range starts and how many to take from it."""
        running = (
            Window.partitionBy("_s").orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
        )
        cuts = (
            counts.withColumn("_before", F.sum("n").over(running) - F.col("n"))
            .join(wanted, "_s")
            .where(F.col("_before") < F.col("_take"))
            .groupBy("_s")
            .agg(
                F.max("_from").alias("_low"),
                F.max_by(F.col("_take") - F.col("_before"), "_from").alias("_take"),
                F.first("_quota").alias("_quota"),
                F.max_by("n", "_from").alias("_border"),
            )
        )
        return materialize(cuts, "cuts")

    def _border_size(self) -> int | None:
        return self._cuts.agg(F.max("_border")).first()[0]

    def _placed(self) -> DataFrame:
        cuts = self._cuts.select("_s", "_low", "_take")
        if self._single:
            return self._keyed.withColumns({c: cuts.select(c).scalar() for c in ("_low", "_take")})
        return self._keyed.join(cuts, F.col("_stratum") == F.col("_s"), "left").drop("_s")

    def _in_border(self) -> Column:
        return (F.col("_key") >= F.col("_low")) & (F.col("_key") < F.col("_low") + self._width)

    def quota_total(self) -> int:
        return self._cuts.agg(F.sum("_quota")).first()[0] or 0

    def marked(self) -> DataFrame:
        """All rows with ``selected``."""
        placed, inside = self._placed(), F.coalesce(self._in_border(), F.lit(False))
        clear = placed.where(~inside).withColumn(
            "selected", F.coalesce(F.col("_key") < F.col("_low"), F.lit(False))
        )
        border = with_running_total(
            materialize(placed.where(inside), "border"), ["_key", self._id], "_stratum"
        )
        ranked = border.withColumn("selected", F.col("_running") <= F.col("_take"))
        return clear.unionByName(ranked.drop("_running")).drop("_stratum", "_key", "_low", "_take")


def _at_most(n: int | Column) -> Callable[[DataFrame], DataFrame]:
    limit = F.lit(n).cast("long") if isinstance(n, int) else n
    return lambda sizes: sizes.withColumn("quota", F.least(F.col("size"), limit))


def random_sample(df: DataFrame, n: int | Column, id_col: str = "post_id", **key) -> DataFrame:
    """Exactly ``min(n, rows)`` rows by hash order."""
    marked = QuotaSplit(df, None, _at_most(n), id_col, **key).marked()
    return marked.where("selected").drop("selected")


def take_first(df: DataFrame, n: int, id_col: str = "post_id") -> DataFrame:
    """The first ``n`` rows by id, null ids first, for ids of any type that has an order.

    Only ids are sorted, in ranges; the rows up to the last one are then read by it.
    Of rows that share the last id, as many are taken as there is room for.
    """
    ids = with_running_total(df.select(F.col(id_col).alias("_id")), ["_id"])
    taken = materialize(ids.where(F.col("_running") <= n).select(F.struct("_id").alias("_id")), "first-ids")
    last = taken.agg(F.max("_id")).scalar()
    own = F.struct(F.col(id_col).alias("_id"))
    room = taken.where(F.col("_id") == last).count()
    return df.where(own < last).unionByName(df.where(own == last).limit(room))


def sample_quotas(sizes: DataFrame, n: int) -> DataFrame:
    """``min(size, max(1, int(n * size / total)))`` per stratum, cut at ``n`` in name order.

    The windows run over one row per stratum.
    """
    share = F.floor(F.lit(n) * F.col("size") / F.sum("size").over(Window.partitionBy()))
    wanted = sizes.withColumn("wanted", F.least("size", F.greatest(F.lit(1), share)))
    before = F.sum("wanted").over(
        Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("wanted")
    room = F.greatest(F.lit(0), F.lit(n) - before)
    return wanted.withColumn("quota", F.least("wanted", room)).drop("wanted")


def stratified_sample(df: DataFrame, n: int, stratum: Column | None = None,
                      id_col: str = "post_id", **key) -> DataFrame:
    """``n`` rows spread over the strata by size, topped up from the rest by hash order."""
    if stratum is None:
        stratum = F.coalesce(F.col("subreddit"), F.col("source"))
    split = QuotaSplit(df, stratum, lambda sizes: sample_quotas(sizes, n), id_col, **key)
    marked = split.marked()
    missing = n - split.quota_total()
    taken = marked.where("selected").drop("selected")
    if missing <= 0:
        return taken
    rest = marked.where(~F.col("selected")).drop("selected")
    return taken.unionByName(random_sample(rest, missing, id_col, **key))


def train_test_split(df: DataFrame, label: str, test_share: float = 0.2,
                     id_col: str = "post_id", **key) -> DataFrame:
    """Add ``split``: per class exactly ``round((1 - test_share) * size)`` rows are train."""

    def quotas(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("quota", F.round(F.col("size") * (1 - test_share)).cast("long"))

    marked = QuotaSplit(df, F.col(label), quotas, id_col, **key).marked()
    return marked.withColumn("split", F.when(F.col("selected"), "train").otherwise("test")).drop(
        "selected"
    )
