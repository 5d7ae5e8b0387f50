"""Verdicts on urls: rules by host and path, and boosted trees on lexical features for the rest.

DataFrame functions and Spark ML only. Urls that a rule judges are the labelled ones; a model is
trained on all of them, each different url once, and judges all others. What it sees of a url:
lengths of the whole, the host and the path; depths of both; shares of digits; entropies of
characters; numbers of parameters; and statistics of its suffixes, that is of the last label of the
host, of its last two labels, and of the file ending: how often labelled urls have it, and which
share of those is blocked. The statistics count all labelled rows and hold every suffix of theirs;
their table may be large, so the planner chooses how to join it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import pick, plain_columns, position, written

ALLOW, BLOCK = "allow", "block"
TREES, DEPTH, STEP = 20, 4, 0.2
SMOOTHING = 5.0  # labelled urls of average share that every suffix starts with
THRESHOLD = 0.5

# fixed values: verdict and rule, a host and the beginning of a path
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SUFFIXES = ("top", "site", "ending")
LEXICAL = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "url_digits", "host_digits",
    "url_entropy", "host_entropy", "parameters", "parameter_length",
)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; empty without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, text.substr(at + len(mark), F.length(text))).otherwise("")


def _until(text: Column, marks: str) -> Column:
    return F.regexp_extract(text, f"^[^{marks}]*", 0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_until(_after(F.coalesce(url, F.lit("")), "://"), "/?#"), *LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(F.coalesce(url, F.lit("")), "://"), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, the first of equally long ones, or null."""
    fitting = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):  # sorted() keeps the order of equals
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        fitting.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*fitting, F.lit(None).cast("string"))


def _verdict_of(rule: Column, rules=RULES) -> Column:
    named = dict(reversed([(rule, verdict) for verdict, rule in rules]))  # the first of equal rules counts
    return F.coalesce(*[F.when(rule == name, F.lit(v)) for name, v in named.items()], F.lit(None).cast("string"))


def _share(text: Column, letters: str) -> Column:
    kept = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(0.0)


def _entropy(text: Column) -> Column:
    """Bits per character: the runs of the sorted characters are their frequencies."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    n = F.length(text)
    spent = F.aggregate(runs, F.lit(0.0), lambda sum_, run: sum_ + F.length(run) * F.log2(F.length(run)))
    return F.when(n > 0, F.log2(n) - spent / n).otherwise(0.0)


def with_features(rows: DataFrame) -> DataFrame:
    """Add the lexical features and suffixes of ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    query = _after(_until(url, "#"), "?")
    last = F.element_at(F.split("path", "/"), -1)
    return rows.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_depth": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))),
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")),
        "url_digits": _share(url, "0-9"), "host_digits": _share(F.col("host"), "0-9"),
        "url_entropy": _entropy(url), "host_entropy": _entropy(F.col("host")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "parameter_length": F.length(query),
        "top": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -2),
        "ending": F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise(""),
    })


def _statistics_names() -> list[str]:
    return [f"{s}_{what}" for s in SUFFIXES for what in ("rows", "blocked")]


@dataclass
class Filter:
    """Statistics of suffixes, (kind, suffix, n, blocked), and trees; without trees the verdict is ``rest``."""

    rules: tuple
    statistics: DataFrame | None
    mean: float
    trees: GBTClassificationModel | None
    rest: str = ALLOW


def _with_statistics(rows: DataFrame, statistics: DataFrame, mean: float) -> DataFrame:
    for kind in SUFFIXES:
        own = statistics.where(F.col("kind") == kind).select(
            F.col("suffix").alias(kind), F.log1p("n").alias(f"{kind}_rows"),
            ((F.col("blocked") + SMOOTHING * mean) / (F.col("n") + SMOOTHING)).alias(f"{kind}_blocked"),
        )
        rows = rows.join(own, kind, "left")
    return rows.fillna({n: mean if n.endswith("blocked") else 0.0 for n in _statistics_names()})


def _suffixes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "label", F.inline(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("suffix")) for s in SUFFIXES]))
    )


def _vector(rows: DataFrame) -> DataFrame:
    names = [*LEXICAL, *_statistics_names()]
    numbers = rows.select("*", *[F.col(n).cast("double").alias(f"f_{n}") for n in names])
    return VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features").transform(numbers).drop(
        *[f"f_{n}" for n in names]
    )


def fit(labelled: DataFrame, rules=RULES, sample: int | None = None) -> Filter:
    """Fit on rows with ``url``, ``host``, ``path`` and ``label`` (1: blocked).

    Trees see every different url once and suffix statistics count all rows. If ``sample`` is given,
    trees see about that many urls, those with the smallest hashes, and only their suffixes get
    statistics. With no rows, or one label only, the verdict is a constant: allow, or the label.
    """
    facts = labelled.agg(
        F.count("*").alias("n"), F.sum("label").alias("blocked"), F.approx_count_distinct("url", 0.02).alias("urls")
    ).first()
    blocked = facts["blocked"] or 0
    if blocked in (0, facts["n"]):
        return Filter(rules, None, 0.0, None, BLOCK if blocked else ALLOW)
    mean = blocked / facts["n"]
    place = F.shiftrightunsigned(F.xxhash64("url"), 1)
    seen = labelled
    if sample is not None and sample < facts["urls"]:
        seen = labelled.where(place <= F.lit(int(sample / facts["urls"] * ((1 << 63) - 1))))
    picked = written(with_features(seen.dropDuplicates(["url"])).orderBy(place, "url"), "labelled-urls")
    suffixes = _suffixes(with_features(labelled))
    if sample is not None:
        suffixes = suffixes.join(_suffixes(picked).select("kind", "suffix").distinct(), ["kind", "suffix"])
    statistics = written(
        suffixes.groupBy("kind", "suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "suffixes"
    )
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1,
    ).fit(_vector(_with_statistics(picked, statistics, mean)).select("features", F.col("label").cast("double")))
    return Filter(rules, statistics, mean, trees)


def labelled_by_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """(url, host, path, label) of the urls that a rule judges."""
    own = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn(
        "verdict", _verdict_of(rule_of(F.col("host"), F.col("path"), rules), rules)
    )
    return own.where("verdict is not null").select(
        "url", "host", "path", (F.col("verdict") == BLOCK).cast("int").alias("label")
    )


def judge(pages: DataFrame, model: Filter | None = None, rules=RULES, id_column: str = "page_id",
          url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row.

    ``verdict`` is the rule's, or else the trees', whose probability of a block is ``score`` (null
    where a rule judges or where there are no trees). Without a model, one is fitted on the urls of
    ``pages`` that a rule judges. A null url, or one without ``://``, has an empty host and path,
    fits no rule and goes to the trees. Repeated rows repeat, null ids come back as null.
    """
    urls = pick(pages, **{id_column: "long", url_column: "string"}).toDF("page_id", "url")
    model = model or fit(labelled_by_rules(urls.select("url"), rules), rules)
    own = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), model.rules))
    verdict = _verdict_of(F.col("rule"), model.rules)
    if model.trees is None:
        scored = ruled.withColumns({"chance": F.lit(None).cast("double"), "guess": F.lit(model.rest)})
    else:
        ready = _vector(_with_statistics(with_features(ruled), model.statistics, model.mean))
        scored = model.trees.transform(ready).withColumn("chance", vector_to_array("probability")[1]).withColumn(
            "guess", F.when(F.col("chance") >= THRESHOLD, BLOCK).otherwise(ALLOW)
        )
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce(verdict, "guess").alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("chance")).alias("score"),
    )


def keep_allowed(pages: DataFrame, model: Filter | None = None, rules=RULES, url_column: str = "url") -> DataFrame:
    """The rows of ``pages`` that are allowed, with all their columns as they are."""
    names = pages.columns
    at = f"_{position(names, url_column)}"
    rows = plain_columns(pages)
    model = model or fit(labelled_by_rules(rows.select(F.col(at).cast("string").alias("url")), rules), rules)
    url = F.col(at).cast("string")
    rule = rule_of(host_of(url), path_of(url), model.rules)
    whole = rows.select(F.struct(*rows.columns).alias("row"), url.alias("url"), rule.alias("rule"))
    own = whole.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    verdict = _verdict_of(F.col("rule"), model.rules)
    if model.trees is None:
        guess = F.lit(model.rest)
    else:
        own = model.trees.transform(_vector(_with_statistics(with_features(own), model.statistics, model.mean)))
        guess = F.when(vector_to_array("probability")[1] >= THRESHOLD, BLOCK).otherwise(ALLOW)
    return own.where(F.coalesce(verdict, guess) == ALLOW).select("row.*").toDF(*names)
