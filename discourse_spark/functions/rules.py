"""Rule matching: 32 labelled patterns in 4 families, as native expressions behind one pass per family."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.fixed_values import RULES

FAMILIES = list(RULES)
LABELS = [label for rules in RULES.values() for label in rules]
FAMILY_OF = {label: family for family, rules in RULES.items() for label in rules}
PATTERN_OF = {label: pattern for rules in RULES.values() for label, pattern in rules.items()}

# Every match of a rule contains one of these fragments. ``contains`` searches
# the UTF-8 bytes directly, so most posts never reach the regex engine.
FRAGMENTS: dict[str, tuple[str, ...]] = {
    "invasion": ("inva",),
    "flood": ("flood",),
    "swarm": ("swarm",),
    "infestation": ("infest",),
    "plague": ("plagu",),
    "vermin": ("vermin", "cockroach", "rat"),
    "animals": ("animal", "beast", "savage", "barbarian"),
    "parasite": ("parasit",),
    "dont_belong": ("belong",),
    "go_back": ("back",),
    "not_like_us": ("like",),
    "their_kind": ("kind",),
    "not_welcome": ("welcome",),
    "get_out": ("get", "leave"),
    "no_place_here": ("place",),
    "send_them_back": ("send",),
    "all_of_them": ("them",),
    "these_ppl_always": ("always",),
    "they_never": ("never",),
    "they_all": ("they'r", "theyr"),
    "all_they_do": ("they",),
    "every_single_one": ("single",),
    "those_people": ("people",),
    "none_of_them": ("none",),
    "taking_over": ("taking",),
    "replacing_us": ("replacing",),
    "replacement": ("replacement",),
    "destroying_our": ("destroying",),
    "under_attack": ("attack",),
    "erase_us": ("eras",),
    "our_culture": ("destroy", "threaten", "eradicate"),
    "white_genocide": ("genocide", "replacement"),
}


def rule_hits(text: Column, label: str, cleaned: bool = True) -> Column:
    """Does one rule match? Raw text is matched case-insensitively in Unicode."""
    if not cleaned:
        return text.rlike("(?iU)" + PATTERN_OF[label])
    fragment = reduce(lambda a, b: a | b, [text.contains(f) for f in FRAGMENTS[label]])
    return fragment & text.rlike(PATTERN_OF[label])


def open_families(text: Column) -> Column:
    """Struct with a boolean per family: false only if none of its rules matches the text.

    RE2 reads a text once per family, however many rules it has, where Java searches once per
    fragment. It takes only ASCII for words, so it sees every word boundary that Java sees.
    """
    joined = {f: "|".join(p.replace(r"\s", r"[\s\x0b]") for p in rules.values()) for f, rules in RULES.items()}

    @F.arrow_udf(", ".join(f"{family} boolean" for family in joined))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.StructArray.from_arrays(
                [pc.match_substring_regex(texts, pattern) for pattern in joined.values()], names=list(joined)
            )

    return found(F.coalesce(text, F.lit("")))


def match_patterns(text: Column, cleaned: bool = True, families: Column | None = None) -> Column:
    """Labels of all matching rules, in declared order.

    With ``families``, a column of ``open_families``, only the rules of open ones are tried.
    """
    text = F.coalesce(text, F.lit(""))

    def matching(labels: Iterable[str]) -> Column:
        return F.array_compact(
            F.array(*[F.when(rule_hits(text, label, cleaned), F.lit(label)) for label in labels])
        )

    if families is None:
        return matching(LABELS)
    none = F.array().cast(T.ArrayType(T.StringType(), False))
    return F.concat(*[F.when(families[f], matching(rules)).otherwise(none) for f, rules in RULES.items()])


def family_hit(matched: Column, family: str) -> Column:
    labels = F.array(*[F.lit(label) for label in RULES[family]])
    return F.arrays_overlap(matched, labels)


def othering_score(matched: Column) -> Column:
    """Number of families with at least one matching rule, 0 to 4."""
    return reduce(lambda a, b: a + b, [family_hit(matched, f).cast("int") for f in FAMILIES])


def pattern_family(label: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in FAMILY_OF.items() for x in pair])
    return F.try_element_at(lookup, label)


def apply_othering(df: DataFrame, text_col: str = "clean_text", cleaned: bool = True) -> DataFrame:
    """Add matched_patterns, othering_score and has_othering.

    The labels are computed once; score and flag are derived from them. Cleaned texts are
    first told apart by the families that may match them.
    """
    matched = F.col("matched_patterns")
    if cleaned:
        opened = df.withColumn("_families", open_families(F.col(text_col)))
        labelled = opened.withColumn(
            "matched_patterns", match_patterns(F.col(text_col), families=F.col("_families"))
        ).drop("_families")
    else:
        labelled = df.withColumn("matched_patterns", match_patterns(F.col(text_col), cleaned))
    return labelled.withColumns(
        {"othering_score": othering_score(matched), "has_othering": F.size(matched) > 0}
    )
