"""Classifiers and routing rules over messages: ordered rules as one column expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnmill.functions.scalar import col, first_match, word_count

from .questions import votes

# Word lists and ordered patterns.
POSITIVE = ("good", "great", "excellent", "love", "happy", "thank")
NEGATIVE = ("bad", "terrible", "hate", "sad", "angry", "frustrated")
HYBRID = ("related to", "relationship", "connect", "prerequisite", "before learning", "should i learn", "learn first", "learning path", "path to learn", "compare", "difference between", "versus", " vs ", "similar to", "how do")
FACT = (("what is ", "what_is"), ("define ", "define"), ("who is ", "who"), ("who was ", "who"), ("when is ", "when"), ("when did ", "when"), ("where is ", "where"), ("how many", "how_many"), ("how much", "how_much"), ("list ", "list"))
CONCEPT = (("explain ", "explain"), ("why does", "why"), ("why is", "why"), ("how does ", "how_does"), ("theory of", "theory"), ("analyze", "analyze"), ("describe", "describe"))
CONCEPTUAL = ("how does", "how do", "why does", "why do", "relate", "relationship", "connection", "compare", "difference", "affect", "effect", "influence", "impact", "depend", "prerequisite", "before", "after")
FACTUAL = ("what is", "define", "list", "name", "identify")
COMPLEX = ("photosynthesis", "mitochondria", "electron", "molecule", "chemical", "reaction", "equation", "theoretical", "analyze")
STOP = ("what", "is", "the", "a", "an", "how", "does", "do", "why", "when", "where", "relate", "relates", "to", "between", "and", "explain", "describe", "define", "list")


def sentiment_score(text: Column | str) -> Column:
    p, n = votes(F.lower(col(text)), POSITIVE), votes(F.lower(col(text)), NEGATIVE)
    return F.when(p > n, F.least(F.lit(0.8), 0.3 + p * F.lit(0.1))).when(n > p, F.greatest(F.lit(-0.8), -0.3 - n * F.lit(0.1))).otherwise(0.0)


def sentiment_label(text: Column | str) -> Column:
    p, n = votes(F.lower(col(text)), POSITIVE), votes(F.lower(col(text)), NEGATIVE)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def _route(text: Column | str) -> tuple[Column, Column, Column, Column]:
    low = F.lower(col(text))
    return (
        first_match(low, [(p, f"hybrid_pattern: {p}") for p in HYBRID]), first_match(low, [(p, f"fact_pattern: {n}") for p, n in FACT]),
        first_match(low, [(p, f"concept_pattern: {n}") for p, n in CONCEPT]),
        F.when(low.contains(",") | (word_count(text) > 50), "complex_query").when(word_count(text) > 15, "long_query").otherwise("short_query"),
    )


def routing_reason(text: Column | str) -> Column:
    return F.coalesce(*_route(text))


def retrieval_type(text: Column | str) -> Column:
    """hybrid, fact or concept: by pattern in that order, else by length."""
    h, f, c, rest = _route(text)
    return F.when(h.isNotNull(), "hybrid").when(f.isNotNull(), "fact").when(c.isNotNull(), "concept").when(rest == "complex_query", "hybrid").when(rest == "long_query", "concept").otherwise("fact")


def query_class(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.coalesce(first_match(low, [(CONCEPTUAL, "concept"), (FACTUAL, "fact")]), F.when(low.startswith("what"), "fact").when(word_count(text) > 10, "concept").otherwise("fact"))


def complexity(text: Column | str) -> Column:
    low, n = F.lower(col(text)), word_count(text)
    asks = col(text).contains("?")
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    total = F.when(n > 100, 0.3).when(n > 50, 0.2).when(n > 20, 0.1).otherwise(0.0) + add(asks & low.contains("why"), 0.15) + add(asks & low.contains("how"), 0.15)
    total = total + add(low.contains("compare") | low.contains("contrast"), 0.2) + add(low.contains("explain"), 0.1) + add(F.regexp_count(col(text), F.lit(r"\?")) > 1, 0.2)
    return F.least(total + add(first_match(low, [(COMPLEX, True)], F.lit(False)), 0.05), F.lit(1.0))


def routing_decision(text: Column | str, purpose: Column | str, has_pii: Column, safe: Column, configured: bool = True, local_available: bool = True, threshold: float = 0.7, local_only=("embedding",), force_cloud=("generation",), always_anonymise: bool = True) -> Column:
    """Struct of use_cloud, reason, complexity_score, pii_detected, recommended_provider, confidence."""
    score, why = complexity(text), col(purpose)
    s = lambda v: F.format_string("%.2f", v)

    def out(cloud: bool, reason, c: Column, provider, sure) -> Column:
        lift = lambda v: F.lit(v) if not isinstance(v, Column) else v
        return F.struct(F.lit(cloud).alias("use_cloud"), lift(reason).alias("reason"), c.cast("double").alias("complexity_score"), has_pii.alias("pii_detected"), lift(provider).alias("recommended_provider"), lift(sure).cast("double").alias("confidence"))

    zero, one = F.lit(0.0), F.lit(1.0)
    if not configured:
        return out(False, "Cloud API key not configured, using local", zero, "local (no cloud key)", 1.0)
    forced, unsafe = why.isin(*force_cloud), has_pii & ~safe
    allowed = F.lit(always_anonymise) & safe
    low = out(False, F.concat(F.lit("Low complexity ("), s(score), F.lit("), local sufficient")), score, "local", 0.9)
    medium = out(False, "Medium complexity, local available and sufficient", score, "local", 0.7) if local_available else F.when(~unsafe, out(True, "Local unavailable, falling back to cloud", score, "cloud (fallback)", 0.6)).otherwise(low)
    return (
        F.when(why.isin(*local_only), out(False, F.concat(F.lit("Local-only for purpose: "), why), zero, "local", 1.0))
        .when(forced & has_pii & allowed, out(True, F.concat(F.lit("Forced cloud for "), why, F.lit(", PII anonymized")), one, "cloud (anonymized)", 0.9))
        .when(forced & has_pii, out(False, F.concat(F.lit("PII detected, cannot use cloud for "), why), zero, "local", 1.0))
        .when(forced, out(True, F.concat(F.lit("Forced cloud for purpose: "), why), one, "cloud", 1.0))
        .when((score >= threshold) & unsafe, out(False, "High complexity but PII detected, using local", score, "local (PII safety)", 0.8))
        .when(score >= threshold, out(True, F.concat(F.lit("High complexity ("), s(score), F.lit(f" >= {threshold})")), score, F.when(has_pii, "cloud (anonymized)").otherwise("cloud"), F.least(score + 0.2, one)))
        .when(score >= 0.4, medium).otherwise(low)
    )


def label_in_text(text: Column | str, labels, hit: float = 0.8, miss: float = 0.3) -> Column:
    """Struct of the first label that occurs in the text, or the first of all, and its confidence."""
    low = F.lower(F.trim(col(text)))
    found = first_match(low, [(x.lower(), x) for x in labels])
    return F.struct(F.coalesce(found, F.lit(labels[0])).alias("label"), F.when(found.isNotNull(), hit).otherwise(miss).alias("confidence"))


def suggested_mode(text: Column | str, kind: Column | None = None) -> Column:
    """focus for long texts, or concept queries where the retrieval type is given; else standard."""
    long = word_count(text) > 50
    return F.when(long if kind is None else long | (kind == "concept"), "focus").otherwise("standard")


def query_terms(text: Column | str, n: int = 5) -> Column:
    words = F.filter(F.split(F.lower(F.trim(col(text))), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOP))
    return F.slice(words, 1, n)
