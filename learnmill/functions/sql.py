"""The set-returning and scalar functions for users of SQL."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

#: name, parameters, result, expression
FUNCTIONS = (
    ("mastery_status", "p double, attempts bigint", "string", "case when p < 0.6 and attempts > 3 then 'STRUGGLING' when p > 0.9 then 'MASTERED' else 'LEARNING' end"),
    ("mastery_prediction", "p double", "double", "0.95D * p + 0.2D * (1 - p)"),
    ("needs_intervention", "p double, attempts bigint, wrong bigint", "boolean", "p < 0.6 and attempts > 3 and wrong >= 2"),
    ("mask_student_id", "id string, role string", "string", "case when role in ('researcher', 'external') then case when length(id) > 8 then concat(substring(id, 1, 8), '...') else '***' end else id end"),
    ("cosine_similarity", "a array<double>, b array<double>", "double",
     "case when aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) > 0 then aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) else 0D end"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions, and (user) tables by function over the view ``student_skills``."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    return [f[0] for f in FUNCTIONS]


def register_student_report(spark: SparkSession) -> str:
    """``student_mastery(user)`` as a table function over the views student_skills and skills_registry."""
    spark.sql("""
        create or replace temporary function student_mastery(who string) returns table (skill_id string, skill_name string, probability_mastery double, status string)
        return select s.skill_id, r.skill_name, s.probability_mastery, mastery_status(s.probability_mastery, s.total_attempts)
          from student_skills s join skills_registry r on s.skill_id = r.skill_id where cast(s.user_id as string) = who""")
    return "student_mastery"


class SimilarRows:
    """Of a partition of a table with columns key and embedding: the k rows nearest to a query by cosine, at or above a
    threshold, ties to the smaller key. What is held is k rows."""

    def __init__(self):
        self.best: list[tuple[float, Any]] = []
        self.k = 0

    def eval(self, row: Row, query: list, threshold: float, k: int) -> Iterator[tuple]:
        self.k = k
        vector = row["embedding"]
        if vector is not None and query is not None and len(vector) == len(query):
            size = math.sqrt(sum(float(x) * x for x in vector) * sum(float(x) * x for x in query))
            similarity = sum(float(x) * y for x, y in zip(vector, query, strict=True)) / size if size else 0.0
            if similarity >= threshold:
                self.best.append((similarity, row["key"]))
                if len(self.best) > 8 * k + 64:
                    self.best = self.first()
        yield from ()

    def first(self) -> list[tuple[float, Any]]:
        return heapq.nsmallest(self.k, self.best, key=lambda x: (-x[0], x[1]))

    def terminate(self) -> Iterator[tuple]:
        for similarity, key in self.first():
            yield key, similarity


def register_similar_rows(spark: SparkSession) -> str:
    """``similar_rows(TABLE(t) PARTITION BY c, query, threshold, k)`` for users of SQL: the nearest rows of each partition of
    any table that has key (bigint) and embedding. It runs a row at a time in Python; a program that can call the
    library takes ``vectors.search_chunks``, whose cosine is generated code."""
    spark.udtf.register("similar_rows", F.udtf(SimilarRows, returnType="key bigint, similarity double"))
    return "similar_rows"
