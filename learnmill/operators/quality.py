"""Rules over rows: good ones, and rejects with their reasons; keys and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with ``reasons``): a rule that is false or null is a reason, by its name."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def event_rules() -> dict[str, Column]:
    return {
        "user_id": F.col("user_id").isNotNull(), "skill_id": F.col("skill_id").isNotNull(), "is_correct": F.col("is_correct").isNotNull(), "attempts": F.col("attempts") >= 1,
        "time_spent_seconds": F.coalesce(F.col("time_spent_seconds") >= 0, F.lit(True)), "event_type": F.coalesce(F.col("event_type").isin("STUDENT_ACTION", "AGENT_ACTION"), F.lit(True)),
    }


def state_rules() -> dict[str, Column]:
    p = F.col("probability_mastery")
    return {"probability_mastery": (p >= 0) & (p <= 1), "total_attempts": F.col("total_attempts") >= F.col("correct_attempts")}


def vector_rule(column: str, size: int) -> dict[str, Column]:
    return {column: F.size(column) == size}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def with_references(df: DataFrame, column: str, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose reference exists, the others)."""
    known = parent.select(F.col(key).alias(column)).distinct()
    return df.join(known, column, "left_semi"), df.join(known, column, "left_anti")


def stamped(df: DataFrame, stamp: Column) -> DataFrame:
    return df.withColumn("updated_at", stamp)
