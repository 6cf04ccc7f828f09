"""URL filter over a sorted array of digests.

A list of (host, path) rules is stored as a sorted array of 64-bit xxhash keys beside the full
strings. Spark ships the file to every executor, whose workers map it into memory. Each url's
host and parent domains are looked up first, which gives the lengths of the paths listed for each; the
candidate keys that follow are found by one vectorised binary search a batch, and the stored strings
confirm each hit.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import LOWER, UPPER, tune

#: Larger lists are joined instead of shipped (see ``filter_urls``).
MAX_FILE_BYTES = 256 << 20
#: The default list: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


@dataclass
class Entry:
    rule: str
    verdict: str


def write_index(rules: list[tuple[str, str, str]], path: str) -> None:
    """One file: counts, sorted keys, string offsets, verdict bits, sorted host keys, offsets of their path
    lengths, the lengths, strings.

    A key is the xxhash of host, a line feed and path, a host key that of the host. Rules with equal host
    and path: block wins. Hosts with equal keys share their lengths.
    """
    best: dict[bytes, bool] = {}
    sizes: dict[int, set[int]] = {}
    for host, place, verdict in rules:
        host = host.translate(str.maketrans(UPPER, LOWER))
        text = f"{host}\n{place}".encode()
        best[text] = best.get(text, False) or verdict == "block"
        sizes.setdefault(xxh64_intdigest(host.encode()), set()).add(len(place))
    entries = sorted((xxh64_intdigest(t), t, block) for t, block in best.items())
    lengths = [sorted(sizes[h]) for h in sorted(sizes)]
    with open(path, "wb") as f:
        f.write(struct.pack("<QQQ", len(entries), len(lengths), sum(map(len, lengths))))
        f.write(np.array([k for k, _, _ in entries], "<u8").tobytes())
        f.write(np.cumsum([0] + [len(t) for _, t, _ in entries]).astype("<u8").tobytes())
        f.write(np.array(sorted(sizes), "<u8").tobytes())
        f.write(np.cumsum([0] + [len(x) for x in lengths]).astype("<u8").tobytes())
        f.write(np.array([n for x in lengths for n in x], "<u8").tobytes())
        f.write(np.array([b for _, _, b in entries], "u1").tobytes())
        f.write(b"".join(t for _, t, _ in entries))


class DigestArray:
    """The file of ``write_index``, mapped into memory: pages are shared by an executor's workers."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n, m, total = struct.unpack("<QQQ", self.raw[:24].tobytes())
        at = 24

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            size = np.dtype(kind).itemsize * count
            out = self.raw[at : at + size].view(kind)
            at += size
            return out

        self.keys, self.offsets = part("<u8", n), part("<u8", n + 1)
        self.hosts, self.spans, self.lengths = part("<u8", m), part("<u8", m + 1), part("<u8", total)
        self.block = part("u1", n)
        self.strings = self.raw[at:]

    def path_lengths(self, hosts: list[str]) -> dict[str, list[int]]:
        """Lengths of the paths listed for each host that may be listed."""
        if not len(self.hosts) or not hosts:
            return {}
        digests = np.array([xxh64_intdigest(h.encode("utf-8", "replace")) for h in hosts], np.uint64)
        at = np.minimum(np.searchsorted(self.hosts, digests), len(self.hosts) - 1)
        hit = np.flatnonzero(self.hosts[at] == digests)
        return {hosts[i]: self.lengths[self.spans[at[i]] : self.spans[at[i] + 1]].tolist() for i in hit.tolist()}

    def probe(self, texts: list[bytes]) -> list[int]:
        """Index of each text in the list, or -1."""
        if not len(self.keys) or not texts:
            return [-1] * len(texts)
        digests = np.array([xxh64_intdigest(t) for t in texts], np.uint64)
        at = np.searchsorted(self.keys, digests)
        out = [-1] * len(texts)
        maybe = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in maybe.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # equal digests stand side by side
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == texts[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def text(self, j: int) -> str:
        return self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes().decode().replace("\n", "", 1)


def domains(host: str) -> list[str]:
    """The host and its parent domains."""
    labels = host.split(".") if host else []
    return [".".join(labels[i:]) for i in range(len(labels))]


def candidates(hosts: list[str], path: str, lengths: dict[str, list[int]]) -> list[tuple[int, str]]:
    """(rule length, host, line feed and path) of every rule that could fit, the longest first."""
    return sorted(((len(h) + n, f"{h}\n{path[:n]}") for h in hosts for n in lengths.get(h, ()) if n <= len(path)), reverse=True)


def ship_index(spark: SparkSession, rules) -> str:
    """Write the index once at the driver and let Spark hand it to the executors; returns its name."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "index")
        write_index(list(rules), path)
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError("the list is too large to ship; pass it as a DataFrame")
        with open(path, "rb") as f:
            name = "urls-" + hashlib.sha256(f.read()).hexdigest()[:24]
        if name not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
            keep = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
            os.replace(path, keep)
            spark.sparkContext.addFile(keep)
        return name


def filter_urls(pages: DataFrame, rules=RULES, keep: list[str] | None = None, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to each page; the longest fitting rule decides.

    A rule fits its host and every subdomain where the path starts with the rule's path. Without a
    rule the url is not in the list: rule null, verdict allow. Null urls, and urls without ``://``,
    have an empty host and fit no rule. ``rules`` is a sequence of (host, path, verdict), or a
    DataFrame of them: one of a proven small size is collected into the file, a larger one is joined
    by key (``join_urls``). One narrow pass; equal rows get equal rows, an empty table gives an empty
    table; of ``keep`` (all columns by default) those named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    tune(spark)
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32).alias("n")).first()["n"] or 0
        if size > MAX_FILE_BYTES // 8:
            return join_urls(pages, rules, keep, url)
        rules = [(r["host"], r["path"], r["verdict"]) for r in rules.select("host", "path", "verdict").dropna().collect()]
    name = ship_index(spark, rules)
    host, path = url_parts(F.col(url))
    base = [c for c in (keep or pages.columns) if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*base, host.alias("host"), path.alias("path"))
    names = parts.columns + ["rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for b in batches:
            above = [domains(h) for h in b.column(len(base)).to_pylist()]
            lengths = index.path_lengths(list({h for hosts in above for h in hosts}))
            found = [candidates(hosts, p, lengths) for hosts, p in zip(above, b.column(len(base) + 1).to_pylist(), strict=True)]
            hits = iter(index.probe([t.encode("utf-8", "replace") for c in found for _, t in c]))
            best = []
            for c in found:
                own = [next(hits) for _ in c]
                best.append(next((j for j in own if j >= 0), -1))
            rule = pa.array([index.text(j) if j >= 0 else None for j in best], pa.string())
            verdict = pa.array(["block" if j >= 0 and index.block[j] else "allow" for j in best])
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=names)

    schema = StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return parts.mapInArrow(run, schema)


def join_urls(pages: DataFrame, rules: DataFrame, keep: list[str] | None = None, url: str = "url") -> DataFrame:
    """``filter_urls`` for a list too large to ship. Distinct hosts meet the domains of the list first and get the
    lengths of the paths listed there; only those are tried for each distinct (host, path), which is then
    joined with the list by both, and the longest hit goes back to the pages. Nulls, repeats, an empty
    table and columns with taken names are as in ``filter_urls``; an empty list allows all."""
    host, path = url_parts(F.col(url))
    base = [c for c in (keep or pages.columns) if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*base, host.alias("host"), path.alias("path"))
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), "verdict").groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    lengths = listed.groupBy("h").agg(F.collect_set(F.length("p")).alias("ns"))  # of a host, at most as many as its longest path
    labels = F.split("host", r"\.")
    pairs = parts.select("host", "path").distinct().where("host <> ''")
    domains = pairs.select("host").distinct().withColumn("h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    tried = pairs.join(domains.join(lengths, "h"), "host").withColumn("n", F.explode("ns")).where(F.col("n") <= F.length("path"))
    spread = tried.select("host", "path", "h", "n", F.expr("left(path, n)").alias("p"))
    best = spread.join(listed, ["h", "p"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), F.struct(F.length("h") + F.col("n"), "h")).alias("hit"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(*base, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))


#: The default list as DuckDB SQL.
ORACLE_SQL = r"""
with parts as (
  select page_id, strpos(coalesce(url, ''), '://') as pos, coalesce(url, '') as url from pages),
cut as (
  select page_id,
    case when pos > 0 then translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from parts),
rules(h, p, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits as (
  select page_id, host, path, h || p as rule, verdict,
    row_number() over (partition by page_id order by length(h || p) desc, h desc) as k
  from cut left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hits where k = 1
"""
