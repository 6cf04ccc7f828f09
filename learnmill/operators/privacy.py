"""Personal data: detection with offsets, overlap rules, masking, reports, and row policies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnmill.functions.scalar import col

# Kind, confidence, label, patterns (as Java regular expressions).
RULES = (
    ("email", 0.95, "[EMAIL]", (r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",)),
    ("phone", 0.85, "[PHONE]", (r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}", r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", r"\b\d{10}\b", r"\b1?\d{10}\b")),
    ("ssn", 0.90, "[SSN]", (r"\b\d{3}-\d{2}-\d{4}\b",)),
    ("credit_card", 0.80, "[CREDIT_CARD]", (r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b")),
    ("ip_address", 0.75, "[IP]", (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",)),
    (
        "date_of_birth", 0.60, "[DATE]",
        (r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])[-/](?:19|20)\d{2}\b", r"\b(?:0[1-9]|[12]\d|3[01])[-/](?:0[1-9]|1[0-2])[-/](?:19|20)\d{2}\b", r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    ),
    ("address", 0.55, "[ADDRESS]", (r"(?i)\b\d+\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Place|Pl)\b",)),
    ("url", 0.90, "[URL]", (r"(?i)https?://(?:www\.)?[A-Za-z0-9-]+\.[A-Za-z]{2,}(?:/\S*)?",)),
    ("username", 0.65, "[USERNAME]", (r"@[A-Za-z0-9_]{3,15}", r"(?i)\b[A-Za-z0-9_]{3,15}\s+(?:said|wrote|commented)")),
)
NAME_CONTEXT = (r"(?i)(\b(?:my name is|i am|i'm|call me|this is)\s+)([A-Z][a-z]+)", r"(?i)(\b(?:mr\.|mrs\.|ms\.|dr\.|prof\.)\s+)([A-Z][a-z]+)")
# First names.
FIRST_NAMES = frozenset((
    "james", "john", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "christopher", "daniel", "matthew", "anthony", "donald", "mark",
    "paul", "steven", "andrew", "kenneth", "joshua", "kevin", "brian", "george", "edward", "ronald", "timothy", "jason", "jeffrey", "ryan", "jacob", "gary", "nicholas",
    "eric", "jonathan", "stephen", "larry", "justin", "scott", "brandon", "benjamin", "samuel", "raymond", "gregory", "frank", "alexander", "mary", "patricia",
    "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "nancy", "lisa", "betty", "margaret", "sandra", "ashley", "kimberly", "emily",
    "donna", "michelle", "dorothy", "carol", "amanda", "melissa", "deborah", "stephanie", "rebecca", "sharon", "laura", "cynthia", "kathleen", "amy", "angela",
    "shirley", "anna", "brenda", "pamela", "emma", "olivia", "cassandra", "sophia", "isabella", "charlotte", "mia", "amelia", "harper", "evelyn", "abigail", "samantha",
    "max", "henry", "noah",
))
SAFE_BELOW = 0.70
ENTITY = "array<struct<start:int,end:int,type:string,confidence:double,label:string,text:string>>"


ENTITY_TYPE = T.ArrayType(
    T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType()),
    ])
)


#: What a text must hold for a kind's patterns to match at all; a text without it is not searched for them.
NEEDS = {
    "email": re.compile("@"), "phone": re.compile(r"\d{3}"), "ssn": re.compile(r"\d-\d{2}-\d"), "credit_card": re.compile(r"\d{4}"), "ip_address": re.compile(r"\d\.\d"),
    "date_of_birth": re.compile(r"\d[-/]\d"), "address": re.compile(r"\d\s"), "url": re.compile("(?i)http"), "username": re.compile("(?i)@|said|wrote|commented"),
}


def found_in(text: str, rules, contexts) -> list[tuple]:
    """(start, end, type, confidence, label, text) of all matches of a text, before overlaps."""
    out = [(m.start(), m.end(), kind, sure, label, m[0]) for kind, sure, label, patterns in rules if NEEDS[kind].search(text) for p in patterns for m in p.finditer(text)]
    for p in contexts:
        out += [(m.start(2), m.end(2), "name", 0.50, "[NAME]", m[2]) for m in p.finditer(text) if m[2].lower() in FIRST_NAMES]
    return out


def kept(found: list[tuple]) -> list[tuple]:
    """By start; one that overlaps the last kept takes its place if it is surer."""
    out: list[tuple] = []
    for e in sorted(found, key=lambda x: x[0]):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
        elif e[3] > out[-1][3]:
            out[-1] = e
    return out


def entities(text: Column | str, with_names: bool = True) -> Column:
    """All entities of a text in order of place, overlaps resolved. The patterns run on Arrow batches,
    once a row: as a column expression they would be run again wherever the optimizer puts a copy."""

    @F.pandas_udf(ENTITY_TYPE)
    def detect(texts: pd.Series) -> pd.Series:
        rules = [(kind, sure, label, [re.compile(p) for p in patterns]) for kind, sure, label, patterns in RULES]
        contexts = [re.compile(p) for p in NAME_CONTEXT] if with_names else []
        return pd.Series([kept(found_in(t or "", rules, contexts)) for t in texts])

    return detect(col(text))


def resolve(found: Column) -> Column:
    """Entities by start; one that overlaps the last kept takes its place if it is surer."""
    def add(kept: Column, e: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        overlap = (F.size(kept) > 0) & (e["start"] < last["end"])
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(e))
        return F.when(~overlap, F.concat(kept, F.array(e))).when(e["confidence"] > last["confidence"], swapped).otherwise(kept)

    by_start = F.array_sort(found.cast(ENTITY), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.aggregate(by_start, F.array().cast(ENTITY), add)


def merge_entities(a: Column, b: Column) -> Column:
    return resolve(F.concat(a, b))


def mask(text: Column | str, found: Column | str, labels: bool = True, sign: str = "*") -> Column:
    """The text with every entity replaced by its label, or by as many signs."""
    t = F.coalesce(col(text), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(a: Column, e: Column) -> Column:
        put = e["label"] if labels else F.repeat(F.lit(sign), e["end"] - e["start"])
        return F.struct(F.concat(a["out"], F.substring(t, a["at"] + 1, e["start"] - a["at"]), put).alias("out"), e["end"].alias("at"))

    return F.aggregate(col(found), start, add, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))


def anonymise(df: DataFrame, text: str = "text", labels: bool = True) -> DataFrame:
    """Replace ``text`` by anonymized_text, has_pii, pii_count, pii_types and safe_for_cloud."""
    found = df.withColumn("__found", entities(text)).withColumn("anonymized_text", mask(text, "__found", labels))
    high = F.exists("__found", lambda e: e["confidence"] >= SAFE_BELOW)
    out = found.withColumns({"has_pii": F.size("__found") > 0, "pii_count": F.size("__found"), "pii_types": F.array_sort(F.transform("__found", lambda e: e["type"])), "safe_for_cloud": ~high})
    return out.drop(text, "__found")


def pii_counts(df: DataFrame, key: str, text: str = "text", kinds=None) -> DataFrame:
    """(key, type, n) for each kind of entity in each text."""
    rows = df.select(key, F.explode(entities(text)).alias("e"))
    return rows.groupBy(key, F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def pattern_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Matches of each kind's patterns in each text, before overlaps are resolved. Digits, words and
    spaces are those of Unicode, as in ``entities``."""
    counts = []
    for kind, _, _, patterns in RULES:
        total = F.lit(0)
        for p in patterns:
            total = total + F.regexp_count(col(text), F.lit("(?U)" + p))
        counts.append(F.when(col(text).rlike("(?U)" + NEEDS[kind].pattern), total).otherwise(0).cast("long").alias(kind))
    return df.select(key, *counts)


def masked_user(user: Column | str, salt: str) -> Column:
    """A pseudonym that is the same on every executor for one salt."""
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(F.lit(salt), col(user).cast("string")), 256), 1, 16))


def masked_student(user: Column | str, role: Column | str) -> Column:
    u = col(user).cast("string")
    short = F.when(F.length(u) > 8, F.concat(F.substring(u, 1, 8), F.lit("..."))).otherwise("***")
    return F.when(col(role).isin("researcher", "external"), short).otherwise(u)


def pii_report(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """(counts by type, offending rows with the types found and the first 100 signs)."""
    rows = lines.withColumn("__e", entities(text)).where(F.size("__e") > 0)
    kinds = rows.select(F.explode("__e").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))
    return kinds, rows.withColumns({"types": F.array_distinct(F.transform("__e", lambda e: e["type"])), "preview": F.substring(text, 1, 100)}).drop("__e")


def privacy_gate(df: DataFrame, text: str = "anonymized_text") -> tuple[DataFrame, DataFrame]:
    """(rows without anything left to mask, the others)."""
    left = F.size(entities(text)) > 0
    return df.where(~left), df.where(left)


# Table, action, roles that may; "own" lets users at their own rows.
STAFF = ("instructor", "admin")
EVERYONE = ("student", *STAFF)
POLICIES = (
    *((t, "select", EVERYONE, False) for t in ("textbook_chunks", "graph_nodes", "graph_edges", "chunk_concept_links", "questions")),
    *((t, "insert", STAFF, False) for t in ("textbook_chunks", "questions")),
    *((t, "update", STAFF, False) for t in ("textbook_chunks", "questions")),
    *((t, "delete", ("admin",), False) for t in ("textbook_chunks", "questions")),
    *((t, "all", STAFF, False) for t in ("graph_nodes", "graph_edges", "chunk_concept_links", "skills_registry")),
    ("skills_registry", "select", ("*",), False),
    ("learning_events", "select", STAFF, False), ("learning_events", "select", ("*",), True), ("learning_events", "insert", (*STAFF, "system"), False),
    ("student_skills", "select", STAFF, False), ("student_skills", "select", ("*",), True), ("student_skills", "all", (*STAFF, "system"), False),
)


def apply_policy(df: DataFrame, table: str, role: str, user_id=None, action: str = "select") -> DataFrame:
    """The rows of a table that a role may read or change: all, its own, or none."""
    fits = [own for t, a, roles, own in POLICIES if t == table and a in (action, "all") and ("*" in roles or role in roles)]
    if False in fits:
        return df
    return df.where(F.col("user_id") == F.lit(user_id)) if fits and user_id is not None else df.where(F.lit(False))
