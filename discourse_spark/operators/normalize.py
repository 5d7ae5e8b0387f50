"""Schema normalisation: find, name, fill and cast the columns of a post table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.fixed_values import DATE_COLUMNS, MIN_TEXT_LENGTH, TEXT_ALIASES


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def detect_text_column(df: DataFrame) -> tuple[str | None, str]:
    """Find the text column and say how: exact, case-insensitive, inferred, ambiguous.

    Names are tried first. Only if none fits, one aggregation over the string
    columns measures their mean length; the driver sees one number per column.
    """
    for alias in TEXT_ALIASES:
        if alias in df.columns:
            return alias, "exact"
    by_lower = {c.lower(): c for c in df.columns}
    for alias in TEXT_ALIASES:
        if alias.lower() in by_lower:
            return by_lower[alias.lower()], "case-insensitive"
    candidates = string_columns(df)
    if not candidates:
        return None, "not_found"
    means = df.agg(*[F.avg(F.length(F.col(f"`{c}`"))).alias(c) for c in candidates]).first()
    long_columns = [c for c in candidates if means[c] is not None and means[c] > 30]
    if not long_columns:
        return None, "not_found"
    longest = max(long_columns, key=lambda c: means[c])
    return longest, "inferred" if len(long_columns) == 1 else "ambiguous"


def rename_text(df: DataFrame, column: str | None) -> DataFrame:
    """Make ``column`` the ``text`` column; without one, ``text`` is empty."""
    if column is None:
        return df.withColumn("text", F.lit(""))
    names = df.columns
    taken = names.index(column)
    # by position: names that differ in case only are one name to Spark
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[
        F.col(f"_{i}").alias("text" if i == taken else name)
        for i, name in enumerate(names) if i == taken or name.lower() != "text"
    ])


def ensure_columns(df: DataFrame, defaults: Mapping[str, tuple[str, object]],
                   fill: bool = True) -> DataFrame:
    """Add missing columns as ``name -> (type, default)``; fill nulls of present ones."""
    new = {}
    for name, (data_type, default) in defaults.items():
        if name not in df.columns:
            new[name] = F.lit(default).cast(data_type)
        elif fill and default is not None:
            new[name] = F.coalesce(F.col(name), F.lit(default).cast(data_type))
    return df.withColumns(new)


def coerce_numeric(df: DataFrame, columns: Sequence[str], default: float | None = None) -> DataFrame:
    """Cast to double; what does not parse, and NaN, becomes null or ``default``."""
    new = {}
    for name in columns:
        if name in df.columns:
            number = F.col(name).try_cast("double")
            number = F.when(~F.isnan(number), number)
            new[name] = number if default is None else F.coalesce(number, F.lit(float(default)))
    return df.withColumns(new)


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    first = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name, i)
    return positional.select(*[F.col(f"c{i}").alias(name) for name, i in first.items()])


def _first_format(value: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def parse_timestamp(value: Column) -> Column:
    """Parse the date spellings found in post exports; null when none fits.

    Besides what casts: month and day or year first with slashes, months by name (short or
    long, before or after the day), weekdays in front, ``GMT`` or an offset behind, 24 hours
    or 12 with ``am`` and ``pm``. Of two numbers before a year the first is the month unless
    only the second can be. A shape is recognised before its formats are tried.
    """
    plain = F.btrim(value)
    for pattern, replacement in (
        (r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", ""),
        (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1"),
        (r"(?i) *\b(gmt|utc|ut|z)$", " +0000"),
        (r"(?i)(\d) *([ap])\.?m\.?$", "$1 $2m"),
        (r", *", " "),
    ):
        plain = F.regexp_replace(plain, pattern, replacement)
    clock, noon = "[ H:mm[:ss]][ Z]", " h:mm[:ss] a"

    def shaped(*dates: str) -> Column:
        return _first_format(plain, *[d + clock for d in dates], *[d + noon for d in dates])

    return F.coalesce(
        value.try_cast("timestamp"),
        F.when(plain.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), shaped("M/d/yyyy", "d/M/yyyy"))
        .when(plain.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), shaped("yyyy/M/d"))
        .when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2} "), shaped("yyyy-M-d"))
        .when(plain.rlike(r"^[A-Za-z]{3} \d{1,2} \d{4}"), shaped("MMM d yyyy"))
        .when(plain.rlike(r"^[A-Za-z]{3} \d"), _first_format(plain, "MMM d HH:mm:ss Z yyyy"))
        .when(plain.rlike(r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}"), shaped("d MMM yyyy", "d-MMM-yyyy")),
    )


def parse_post_date(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Add post_date from the first date column of which at least half parses.

    One aggregation decides; without a usable column the frame is unchanged.
    """
    candidates = [c for c in DATE_COLUMNS if c in df.columns]
    if not candidates:
        return df
    shares = df.agg(
        *[
            F.try_divide(
                F.count(parse_timestamp(F.col(f"`{c}`").cast("string"))), F.count(F.col(f"`{c}`"))
            ).alias(c)
            for c in candidates
        ]
    ).first()
    for c in candidates:
        if shares[c] is not None and shares[c] >= min_share:
            return df.withColumn("post_date", parse_timestamp(F.col(f"`{c}`").cast("string")))
    return df


def epoch_to_date(df: DataFrame, column: str = "created_utc") -> DataFrame:
    """Keep rows with a usable epoch; add ``date`` and ``year_month``."""
    epoch = F.col(column).try_cast("double")
    dated = df.where(epoch.isNotNull() & ~F.isnan(epoch) & (epoch != 0)).withColumn(
        "date", F.timestamp_seconds(epoch)
    )
    return dated.withColumn("year_month", F.date_format("date", "yyyy-MM"))


def merge_title_body(title: Column, body: Column) -> Column:
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return strip(joined)


# Unicode white space, spelled as the set that trimming removes.
_WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def min_length_filter(df: DataFrame, column: str = "text", n: int = MIN_TEXT_LENGTH,
                      stripped: bool = False) -> DataFrame:
    value = strip(F.col(column)) if stripped else F.col(column)
    return df.where(F.length(value) >= n)


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def keep_years(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """A range on the raw column, so that it is pushed into the scan."""
    return df.where(
        (F.col(column) >= F.lit(f"{first}-01-01").cast("timestamp"))
        & (F.col(column) < F.lit(f"{last + 1}-01-01").cast("timestamp"))
    )


def parse_pattern_list(value: Column) -> Column:
    """Read ``"['a', 'b']"`` as an array; anything else is an empty array."""
    parsed = F.from_json(F.translate(value, "'", '"'), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def profile(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: rows, columns, mean text length, number of short texts."""
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.avg(length).alias("mean_length"),
        F.count_if(length < MIN_TEXT_LENGTH).alias("n_short"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def unify_posts(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack unlike tables by column name; missing columns are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def union_posts(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack analysed tables and restore the types of flag and score."""
    merged = unify_posts([drop_duplicate_columns(f) for f in frames])
    merged = ensure_columns(
        merged, {"othering_predicted": ("int", 0), "othering_score": ("int", 0)}, fill=False
    )
    merged = coerce_numeric(merged, ["othering_predicted", "othering_score"], default=0)
    return merged.withColumn("othering_predicted", F.col("othering_predicted").cast("int"))


def ingest(comments: DataFrame, forum: DataFrame, text_col: str,
           subreddits: Sequence[str]) -> DataFrame:
    """Two raw corpora as one table of text, source and subreddit."""
    kept = keep_values(forum, "subreddit", subreddits).withColumn(
        "text", merge_title_body(F.col("title"), F.col("selftext"))
    )
    shared = ["text", "source", "subreddit"]
    left = min_length_filter(
        comments.withColumn("text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    ).withColumns({"source": F.lit("hate_speech"), "subreddit": F.lit(None).cast("string")})
    right = min_length_filter(kept).withColumn("source", F.lit("reddit"))
    return min_length_filter(
        left.select(*shared).unionByName(right.select(*shared)), stripped=True
    )


def replace_dataset(existing: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Upsert: rows of the labelled dataset are replaced by ``new``."""
    return remove_dataset(existing, label).unionByName(
        new.withColumn("dataset", F.lit(label)), allowMissingColumns=True
    )


def remove_dataset(existing: DataFrame, label: str) -> DataFrame:
    """Rows of all other datasets, those without a dataset included."""
    return existing.where(~F.col("dataset").eqNullSafe(label))
