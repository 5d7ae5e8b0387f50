"""Model scores for posts through pluggable scorers.

A scorer is any callable from a list of texts to a list of ``{label: score}``.
Operators take a ``load`` function instead, which each task calls once, so that
weights are loaded per task and not per row or per batch. Rows that need no score
are sent as nulls and skipped, which needs no join to put scores back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discourse_spark.fixed_values import TOXICITY_COLUMNS, TOXICITY_LABEL_MAP
from discourse_spark.operators.store import once_per_text

Scorer = Callable[[list[str]], list[dict[str, float]]]


class KeywordScorer:
    """Share of a text's words that belong to each label's word list.

    Stands in where no model weights are at hand. With ``rest`` the remaining
    share goes to that label.
    """

    def __init__(self, words: Mapping[str, Sequence[str]], rest: str | None = None) -> None:
        self.words = {label: frozenset(w) for label, w in words.items()}
        self.listed = frozenset().union(*self.words.values())
        self.rest = rest

    def __call__(self, texts: list[str]) -> list[dict[str, float]]:
        results = []
        for text in texts:
            split = text.split()
            found = Counter(filter(self.listed.__contains__, split))
            n = max(len(split), 1)
            scores = {label: sum(found[w] for w in ws) / n for label, ws in self.words.items()}
            if self.rest is not None:
                scores[self.rest] = max(0.0, 1.0 - sum(scores.values()))
            results.append(scores)
        return results


FAILED: dict[str, float] = {"": float("nan")}  # told by identity, not by content


def _score_series(series: pd.Series, scorer: Scorer, batch_size: int,
                  keep_going: bool) -> list[dict[str, float] | None]:
    """One result per text, in batches of present texts.

    None stands for an absent text, FAILED for a text of a failed batch.
    """
    texts = series.tolist()
    present = [i for i, text in enumerate(texts) if text is not None]
    results: list[dict[str, float] | None] = [None] * len(texts)
    for start in range(0, len(present), batch_size):
        places = present[start:start + batch_size]
        try:
            scored = scorer([texts[i] for i in places])
        except Exception:
            if not keep_going:
                raise
            scored = [FAILED] * len(places)
        for i, result in zip(places, scored):
            results[i] = result
    return results


def scores_of(text: Column, load: Callable[[], Scorer], label_map: Mapping[str, str],
              batch_size: int = 64, keep_going: bool = False, decimals: int | None = None) -> Column:
    """Struct of score columns. Labels a scorer does not return are 0.0.

    Null texts get null scores. With ``keep_going`` a batch whose scorer fails
    gets null scores instead of failing the job.
    """
    names = list(label_map.values())
    schema = ", ".join(f"`{n}` double" for n in names)

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for series in batches:
            table = [
                [float(result.get(label, 0.0)) if result is not None and result is not FAILED else None for label in label_map]
                for result in _score_series(series, scorer, batch_size, keep_going)
            ]
            out = pd.DataFrame(table, columns=names, dtype="float64")
            yield out if decimals is None else out.round(decimals)

    return score(text)


def top1_of(text: Column, load: Callable[[], Scorer], batch_size: int = 32,
            keep_going: bool = False, decimals: int = 4) -> Column:
    """Struct (label, score) of the best label; ("neutral", 0.0) for a failed batch."""

    @F.pandas_udf("label string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for series in batches:
            best_of = []
            for result in _score_series(series, scorer, batch_size, keep_going):
                if result is None:
                    best_of.append((None, None))
                elif result is FAILED or not result:
                    best_of.append(("neutral", 0.0))
                else:
                    best_of.append(min(result.items(), key=lambda kv: (-kv[1], kv[0])))
            out = pd.DataFrame(best_of, columns=["label", "score"])
            out["score"] = out["score"].astype("float64").round(decimals)
            yield out

    return best(text)


def _input(text_col: str, max_chars: int | None) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def score_batches(df: DataFrame, load: Callable[[], Scorer],
                  label_map: Mapping[str, str] = TOXICITY_LABEL_MAP,
                  text_col: str = "clean_text", batch_size: int = 64,
                  keep_going: bool = False) -> DataFrame:
    """Add one column per mapped label."""
    scored = df.withColumn(
        "_scores", scores_of(_input(text_col, None), load, label_map, batch_size, keep_going)
    )
    return scored.withColumns(
        {name: F.col(f"_scores.{name}") for name in label_map.values()}
    ).drop("_scores")


def score_resumable(df: DataFrame, path: str, load: Callable[[], Scorer],
                    label_map: Mapping[str, str] = TOXICITY_LABEL_MAP, text_col: str = "clean_text",
                    batch_size: int = 64, id_col: str = "post_id", ranges: int = 16,
                    tries: int = 1) -> DataFrame:
    """Add one column per mapped label by hash ranges of the texts, each committed when it is done.

    A run that ends early goes on where it was when it is called again with the same ``path``.
    """
    def score(texts: DataFrame) -> DataFrame:
        return score_batches(texts, load, label_map, text_col, batch_size)

    return once_per_text(df, path, score, text_col, id_col, ranges, tries)


def top1_label(df: DataFrame, load: Callable[[], Scorer], text_col: str = "clean_text",
               max_chars: int | None = None, batch_size: int = 32,
               keep_going: bool = False) -> DataFrame:
    """Add emotion and emotion_score. ``max_chars`` is for models with an input limit."""
    best = top1_of(_input(text_col, max_chars), load, batch_size, keep_going)
    return df.withColumn("_best", best).withColumns(
        {"emotion": F.col("_best.label"), "emotion_score": F.col("_best.score")}
    ).drop("_best")


def fill_missing_toxicity(df: DataFrame, load: Callable[[], Scorer],
                          label_map: Mapping[str, str] = TOXICITY_LABEL_MAP,
                          text_col: str = "clean_text", batch_size: int = 32) -> DataFrame:
    """Score only rows without toxicity; a failed batch stays null."""
    missing = F.col("toxicity").isNull()
    text = F.when(missing, _input(text_col, None))
    scored = df.withColumn("_scores", scores_of(text, load, label_map, batch_size, True, 4))
    present = {c: F.col(c) if c in df.columns else F.lit(None).cast("double")
               for c in label_map.values()}
    return scored.withColumns(
        {c: F.when(missing, F.col(f"_scores.{c}")).otherwise(old) for c, old in present.items()}
    ).drop("_scores")


def fill_missing_emotion(df: DataFrame, load: Callable[[], Scorer], text_col: str = "clean_text",
                         batch_size: int = 16) -> DataFrame:
    """Label only rows without an emotion; a failed batch becomes ("neutral", 0.0)."""
    missing = F.col("emotion").isNull()
    text = F.when(missing, _input(text_col, None))
    score = F.col("emotion_score") if "emotion_score" in df.columns else F.lit(None).cast("double")
    return (
        df.withColumn("_best", top1_of(text, load, batch_size, True))
        .withColumns(
            {
                "emotion": F.when(missing, F.col("_best.label")).otherwise(F.col("emotion")),
                "emotion_score": F.when(missing, F.col("_best.score")).otherwise(score),
            }
        )
        .drop("_best")
    )


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing values and coverage in percent, one row per column."""
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    long = rows.unpivot("n_rows", list(columns), "column", "n_present")
    return long.select(
        "column", "n_rows", (F.col("n_rows") - F.col("n_present")).alias("n_missing"),
        F.coalesce(F.try_divide(F.col("n_present") * 100.0, F.col("n_rows")), F.lit(0.0))
        .alias("coverage_pct"),
    )


def propagate_scores(source: DataFrame, target: DataFrame,
                     columns: Sequence[str] = tuple(TOXICITY_COLUMNS),
                     id_col: str = "post_id") -> tuple[DataFrame, bool]:
    """Copy score columns to a sibling table by key; a table of another size is skipped.

    The key is unique on both sides, so the join has no hot keys.
    """
    if source.count() != target.count():
        return target, False
    kept = target.drop(*columns)
    return kept.join(source.select(id_col, *columns), id_col, "left"), True
