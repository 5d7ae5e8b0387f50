"""Secrets in texts, with corpus-wide ownership frequency. DataFrame functions only.

Candidates are values behind key words, access ids, long hexadecimal runs, and, as what
the method adds, long runs that mix capital and small letters with digits. Each value is
counted over the whole corpus: how many owners and how many repositories hold it. What
``EXAMPLE_OWNERS`` or more owners hold is a widely copied example; what fewer hold
looks live. Repositories lie within owners here, so that their number adds nothing to a
verdict that asks for both; many repositories of few owners are no sign of an example. Mixed runs are reported only if they look live, the other kinds always.

Positions come from the text between matches: a match starts after all earlier gaps
and matches. Only texts with matches leave the scan, as one row per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.llm.common import id_or_last, pick, plain_columns, position, written

# fixed values: what counts as a candidate, in the order of the kinds
KINDS = ("assign", "access", "hex", "mixed")
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ASSIGN_LEAST = 6
EXAMPLE_OWNERS = 3
MASK = "[secret]"


def _matches(kind: int, pattern: str, group: int, text: Column) -> Column:
    """Array of (kind, i, gap, size, value); null if the pattern isn't there."""
    rule = F.lit(pattern)
    whole = F.regexp_extract_all(text, rule, F.lit(0))
    value = F.regexp_extract_all(text, rule, F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("size"), m["value"].alias("value"),
        ),
    )
    return F.when(F.regexp(text, rule), rows)


def _looks_mixed(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def candidates(rows: DataFrame) -> DataFrame:
    """One row per candidate: the columns of ``rows`` but the text, kind, start, end, value.

    ``rows`` has ``row_id``, ``rid`` and ``text``. Equal rows give their candidates once.
    """
    text = F.col("text")
    found = [
        _matches(0, ASSIGN, 2, text), F.when(F.contains(text, F.lit("AKIA")), _matches(1, ACCESS, 0, text)),
        _matches(2, HEX, 0, text), _matches(3, MIXED, 0, text),
    ]
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>")
    together = F.concat(*[F.coalesce(f, empty) for f in found])
    per_match = (
        rows.withColumn("_found", together).drop("text").where(F.size("_found") > 0)
        .withColumn("_m", F.explode("_found")).select("*", "_m.*").drop("_found", "_m")
        .dropDuplicates(["row_id", "rid", "kind", "i"])
    )
    order = Window.partitionBy("row_id", "rid", "kind").orderBy("i")
    until = F.sum(F.col("gap") + F.col("size")).over(order)
    return (
        per_match.withColumn("end", until).withColumn("start", F.col("end") - F.col("size"))
        .drop("i", "gap", "size")
        .where((F.col("kind") != 0) | (F.length("value") >= ASSIGN_LEAST))
        .where((F.col("kind") != 3) | _looks_mixed(F.col("value")))
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of each value. A value in very many documents is
    brought down to one row per owner and repository first."""
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories")
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         owner_column: str = "source", repository_column: str = "lang") -> DataFrame:
    """(row_id, rid, spans, live) of the documents with spans; both are arrays of
    (start, kind, end), ``live`` those whose value looks live.

    A repository is an owner together with ``repository_column``. A null owner or
    repository counts as one of its own name.
    """
    rows = _keyed(docs, id_column, text_column, owner_column, repository_column)
    found = written(
        candidates(rows).withColumn("hash", F.xxhash64("value")).drop("value"), "candidates"
    )
    rated = found.join(ownership(found), "hash").withColumn("is_live", F.col("n_owners") < EXAMPLE_OWNERS)
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    per_document = rated.groupBy("row_id", "rid").agg(
        F.collect_list(F.when(F.col("kind") != 3, span)).alias("base"),
        F.collect_list(F.when((F.col("kind") == 3) & F.col("is_live"), span)).alias("more"),
        F.collect_list(F.when(F.col("is_live"), span)).alias("live"),
    )
    apart = F.filter("more", lambda m: ~F.exists(
        "base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
    ))
    spans = F.array_sort(F.concat("base", apart))
    return per_document.select(
        "row_id", "rid", spans.alias("spans"),
        F.array_sort(F.array_intersect(F.col("live"), spans)).alias("live"),
    )


def _keyed(docs: DataFrame, id_column: str, text_column: str, owner_column: str, repository_column: str) -> DataFrame:
    rows = pick(docs, **{id_column: "long", text_column: "string", owner_column: "string",
                         repository_column: "string"}).toDF("doc_id", "text", "owner", "repository")
    return rows.select(id_or_last().alias("row_id"), F.xxhash64("text", "owner", "repository").alias("rid"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("owner", F.lit("")).alias("owner"),
                       F.coalesce("repository", F.lit("")).alias("repository"))


def _written_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        )), ","
    )


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           owner_column: str = "source", repository_column: str = "lang") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live) of each document.

    A null text counts as empty and has no spans. Repeated rows get the same answer
    each; null ids come back as null.
    """
    keys = _keyed(docs, id_column, text_column, owner_column, repository_column).select("row_id", "rid")
    given = pick(docs, **{id_column: "long"}).toDF("doc_id")
    found = scan(docs, id_column, text_column, owner_column, repository_column)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = F.coalesce("spans", none)
    base = F.filter(spans, lambda s: s["kind"] != 3)

    def number(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    joined = keys.join(found, ["row_id", "rid"], "left")
    return joined.select(
        F.when(F.col("row_id") != (1 << 63) - 1, F.col("row_id")).alias(given.columns[0]),
        number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_written_spans(base), 256).alias("base_sha256"), _written_spans(spans).alias("spans"),
        F.size(F.coalesce("live", none)).cast("long").alias("n_live"),
    )


def mask(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         owner_column: str = "source", repository_column: str = "lang") -> DataFrame:
    """``docs`` with every live-looking secret in the text replaced by ``MASK``.

    Widely copied examples stay. Documents without live secrets stay as they are, and
    so do their other columns.
    """
    names = docs.columns
    text_at = position(names, text_column)
    found = scan(docs, id_column, text_column, owner_column, repository_column)
    live = found.where(F.size("live") > 0).select("row_id", "rid", "live")
    at = [f"_{position(names, c)}" for c in (id_column, text_column, owner_column, repository_column)]
    rows = plain_columns(docs)
    keyed = rows.withColumn("row_id", F.coalesce(F.col(at[0]).cast("long"), F.lit((1 << 63) - 1))).withColumn(
        "rid", F.xxhash64(*[F.col(c).cast("string") for c in at[1:]])
    )
    joined = keyed.join(live, ["row_id", "rid"], "left")
    text = F.col(f"_{text_at}")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        before = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], before, F.lit(MASK))).otherwise(done["out"]).alias("out"),
        )

    masked = F.aggregate(F.col("live"), start, step, lambda done: F.concat(
        done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
    ))
    return joined.select(*[
        (F.when(F.col("live").isNotNull(), masked).otherwise(text) if i == text_at else F.col(f"_{i}")).alias(n)
        for i, n in enumerate(names)
    ])
