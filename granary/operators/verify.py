"""Answers held against their context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import numeric as n
from granary.functions import text as t

FALLBACK = "Not found in context"
STOP = "the a an is are was were be been being have has had do does did will would could should may might must shall".split()
GENERIC = ("i don't know", "i cannot", "i'm not sure", "based on my knowledge", "in general")


def unsupported(kind: Callable[[str], Column], answer: str, context: str) -> Column:
    """Facts of the answer that the context lacks."""
    return F.array_except(kind(answer), kind(context))


def unsupported_numbers(answer: str, context: str, tolerance: float | None = None) -> Column:
    """Numbers that the context lacks; with a tolerance, those that no number there is near to either."""
    missing = unsupported(t.numbers, answer, context)
    return missing if tolerance is None else F.filter(missing, lambda x: ~n.number_supported(x, t.numbers(context), tolerance))


def check(rows: DataFrame, answer: str = "answer", context: str = "context", numbers: bool = True, dates: bool = True, currencies: bool = True) -> DataFrame:
    """Rows with level1_passed and issues: numbers, dates and amounts without support. Entities are not held against it."""
    kinds = [("numbers", t.numbers, numbers), ("dates", t.dates, dates), ("currencies", t.currencies, currencies)]
    issues = []
    for name, f, on in kinds:
        if on:
            missing = unsupported(f, answer, context)
            issues.append(F.when(F.size(missing) > 0, F.concat(F.lit(f"unsupported {name}: "), F.array_join(missing, ", "))))
    out = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")
    return rows.withColumn("issues", out).withColumn("level1_passed", F.size("issues") == 0)


def heuristic_critic(answer: str, context: str) -> Column:
    """struct(valid, overlap, issues): too little of the answer in the context, or an evasive phrase."""
    def keywords(c: str) -> Column:
        return F.filter(F.array_distinct(t.tokens(c)), lambda w: ~w.isin(*STOP))
    own = keywords(answer)
    overlap = F.when(F.size(own) > 0, F.size(F.array_intersect(own, keywords(context))) / F.size(own))
    low = F.lower(t.col(answer))
    issues = F.array_compact(F.array(F.when(overlap < 0.3, F.format_string("little of it is in the context (%.0f%%)", overlap * 100)), *[F.when(low.contains(p), F.lit(f"evasive: {p}")) for p in GENERIC]))
    return F.struct((F.size(issues) == 0).alias("valid"), overlap.alias("overlap"), issues.alias("issues"))


def verify(rows: DataFrame, answer: str = "answer", context: str = "context", critic: Column | None = None) -> DataFrame:
    """Both levels: status, confidence, issues, level1_passed, level2_passed. The critic, struct(valid, confidence, issues), counts only for rows
    that pass level 1; without one level 2 is null and the confidence 1 or 0.5."""
    out = check(rows, answer, context)
    base = F.when(F.col("level1_passed"), F.lit(1.0)).otherwise(F.lit(0.5))
    if critic is None:
        out = out.withColumn("level2_passed", F.lit(None).cast("boolean")).withColumn("confidence", base)
    else:
        out = out.withColumn("__c", F.when(F.col("level1_passed"), critic))
        out = out.withColumn("level2_passed", F.col("__c.valid")).withColumn("confidence", F.when(F.col("level1_passed"), F.coalesce("__c.confidence", F.lit(0.5))).otherwise(base))
        out = out.withColumn("issues", F.when(F.col("__c.valid") == F.lit(False), F.concat("issues", "__c.issues")).otherwise(F.col("issues"))).drop("__c")
    bad = ~F.col("level1_passed") | ~F.coalesce("level2_passed", F.lit(True))
    return out.withColumn("status", F.when(bad, "invalid").otherwise("valid"))


def critic_from_text(reply: str | Column) -> Column:
    """A model's reply read as a verdict: JSON with valid, confidence and issues; what can't be read is invalid."""
    got = t.json_in(reply, "valid boolean, confidence double, issues array<string>")
    bad = F.struct(F.lit(False).alias("valid"), F.lit(0.5).alias("confidence"), F.array(F.lit("the critic's reply can't be read")).alias("issues"))
    return F.when(got["valid"].isNull(), bad).otherwise(F.struct(got["valid"].alias("valid"), F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(got["issues"], F.array().cast("array<string>")).alias("issues")))


def answer_or_fallback(rows: DataFrame, answer: str = "answer") -> DataFrame:
    return rows.withColumn("final_answer", F.when(F.col("status") == "invalid", FALLBACK).otherwise(F.col(answer)))
