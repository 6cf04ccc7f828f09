"""What several corpus operators share: Arrow batches over texts, hash splits, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Rows and bytes of an Arrow batch, so that long texts do not pile up in a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches where the session has no sizes of its own; what a user has set stays."""
    given = spark.conf.getAll
    for name, value in BATCH.items():
        if name not in given:
            spark.conf.set(name, value)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    make: Callable[[], Callable[[list], list]],
    added: str,
) -> DataFrame:
    """Keep columns ``keep`` and add the columns of DDL ``added``, computed from column ``text``.

    ``make()`` runs once a task and returns a function from a list of texts (None for null) to one
    list for each added column. Narrow: no shuffle, and one Arrow batch in memory at a time. A kept
    column with the name of an added one gives way to it.
    """
    extra = _parse_datatype_string(added)
    new = {f.name.lower() for f in extra.fields}
    keep = [c for c in keep if c.lower() not in new]
    out = StructType([df.schema[c] for c in keep] + extra.fields)
    kinds = [f.type for f in to_arrow_schema(extra)]
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            added = f(b.column(len(keep)).to_pylist())
            arrays = [pa.array(v, type=k) for v, k in zip(added, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + arrays, names=names)

    return df.select(*keep, F.col(text).alias(fresh(df, "__text"))).mapInArrow(run, out)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, train: Column | None = None, balanced: bool = False) -> DataFrame:
    """(doc_id, text, y, rate) of about ``cap`` labelled training documents, drawn by a hash of the id.

    ``rate`` is the share of the row's class that was drawn: one for all, or with ``balanced`` as
    near to half the cap for each class as its rows allow. The label rows are thinned before the
    join, so the broadcast side has about ``cap`` rows however large the table is. Rows that repeat
    an id count once, with the least of their texts and the greatest of their labels; null ids and null
    labels do not count.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.lit(True) if train is None else train))
    rows = rows.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(sizes.values())
    share = {y: min(1.0, cap / (2 * n if balanced else total)) for y, n in sizes.items()}
    parts = 1 << 20
    rate = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(parts)) / parts
    rows = rows.withColumn("rate", rate).where(draw < F.col("rate"))
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"), F.max("rate").alias("rate"))


#: Numbers that one row of ``numbered_copies`` holds at a time.
COPIES = 1 << 16


def numbered_copies(df: DataFrame, copies: str, name: str) -> DataFrame:
    """Each row as often as its column ``copies`` says, numbered from 0 in ``name``; in two steps, so that a row
    which stands for very many does not need them in memory at once."""
    block, n = F.col("__block"), F.col(copies).cast("long")
    blocks = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(cast({copies} as long) - 1) div {COPIES}"))))
    return blocks.withColumn(name, F.explode(F.sequence(block * COPIES, F.least(n, (block + 1) * COPIES) - 1))).drop("__block")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder. Where none is set, a local session makes one
    of its own; on a cluster that is an error, since executors and driver share no other folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = context._jsc.sc().getCheckpointDir()
        root = made.get() if made.isDefined() else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Keys to drop or keep (an id and a hash a row) are broadcast up to so many rows.
BROADCAST_KEYS = 500_000


def sized_side(keys: DataFrame) -> DataFrame:
    """``keys`` written and counted: marked for broadcast if few, else left to a shuffled join."""
    keys = checkpointed(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and cut from its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
