"""Ordered folds over the answers of each (user, skill), with hot keys spread over tasks.

An ordinary key is dealt to one task, sorted, and walked once with one state. A key of more than ``hot``
answers is cut: all answers of such keys are range-partitioned by key and time, so that a key covers a stretch of
several partitions. A first pass walks each partition's first stretch without knowing where it starts, from the
lowest and the highest mastery at once. Each step keeps their order, and as soon as both meet (at a clamp, after a
few right or wrong answers in a row) the rest does not depend on the start any more; counters and streaks add up.
What reaches the driver is one row a partition. It passes the states on from stretch to stretch; a stretch whose
two walks never met is walked again from its start, once that is known. The last pass walks all partitions at
once, each from its own start. Every mastery is the same double that one walk over the key gives.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import pinned

#: Answers of a key up to which one task walks it.
HOT = 1_000_000
#: A mastery of Bayes' rule counts as clamped whatever the start if it lies so far beyond the clamp.
MARGIN = 1e-9


@dataclass(frozen=True)
class State:
    """After some answers: the mastery (between ``low`` and ``high`` while its start is unknown), time of the last
    answer, attempts, right answers, and the streaks, each with whether the other kind has been seen."""

    low: float
    high: float
    last: int | None = None
    n: int = 0
    ok: int = 0
    right: int = 0
    wrong: int = 0
    any_right: bool = False
    any_wrong: bool = False

    def after(self, before: State) -> State | None:
        """This state, reached from an unknown start, if the start was ``before``; None if the mastery is open."""
        if self.low != self.high:
            return None
        return replace(self, **self.counted(before))

    def counted(self, before: State) -> dict:
        return {
            "n": before.n + self.n, "ok": before.ok + self.ok, "right": self.right + (0 if self.any_wrong else before.right), "wrong": self.wrong + (0 if self.any_right else before.wrong),
            "any_right": before.any_right or self.any_right, "any_wrong": before.any_wrong or self.any_wrong,
        }


class Rule:
    """How an answer moves the mastery: ``floor`` and ``ceiling`` bound it, ``step`` is one answer, ``both`` one
    answer for the two walks of an unknown start."""

    start: float
    floor: float
    ceiling: float

    def step(self, p: float, hit: bool, hours: float | None) -> float:
        raise NotImplementedError

    def both(self, low: float, high: float, hit: bool, hours: float | None) -> tuple[float, float]:
        return self.step(low, hit, hours), self.step(high, hit, hours)


class Counting(Rule):
    """No mastery, only the counters."""

    start = floor = ceiling = 0.0

    def step(self, p: float, hit: bool, hours: float | None) -> float:
        return p


def walk(rule: Rule, state: State, us: list, hits: list, attempts: list, emit: Callable | None = None) -> State:
    """The state after some answers of one key in order; ``emit(before, hours, state)`` sees each."""
    low, high, last = state.low, state.high, state.last
    n, ok, right, wrong, any_right, any_wrong = state.n, state.ok, state.right, state.wrong, state.any_right, state.any_wrong
    for t, hit, tries in zip(us, hits, attempts, strict=True):
        before, hours = low, None if last is None else (t - last) / 3.6e9
        if low == high:
            low = high = rule.step(low, bool(hit), hours)
        else:
            low, high = rule.both(low, high, bool(hit), hours)
        last, n = t, n + (tries or 0)
        if hit:
            ok, right, wrong, any_right = ok + 1, right + 1, 0, True
        else:
            right, wrong, any_wrong = 0, wrong + 1, True
        if emit:
            emit(before, hours, low, n, ok, right, wrong)
    return State(low, high, last, n, ok, right, wrong, any_right, any_wrong)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[list]]]:
    """(key, other columns) of each stretch of one key; the key is the first two columns."""
    columns = [c.to_pylist() for c in batch.columns]
    keys = list(zip(columns[0], columns[1], strict=True))
    lo = 0
    while lo < len(keys):
        hi = lo + 1
        while hi < len(keys) and keys[hi] == keys[lo]:
            hi += 1
        yield keys[lo], [c[lo:hi] for c in columns[2:]]
        lo = hi


def number(batch: pa.RecordBatch) -> int | None:
    """Of a batch of a spread fold the partition that it was dealt to."""
    return batch.column("part")[0].as_py() if batch.num_rows else None


def stretches(rule: Rule, batches: Iterator[pa.RecordBatch], first: State | None, goes_on: bool, out) -> Iterator[pa.RecordBatch]:
    """Walk sorted rows (key, key, event_id, us, is_correct, attempts). ``first``: the state that the first key comes
    with, if it does; ``goes_on``: the last key has more rows elsewhere. ``out`` gathers rows and makes batches."""
    begin = State(rule.start, rule.start)
    key, state = None, None
    for batch in batches:
        for k, (event, us, hits, attempts, *_) in slices(batch):
            if state is None or k != key:
                if state is not None:
                    out.ended(key, state)
                state = begin if state is not None or first is None else first
                key = k
            state = walk(rule, state, us, hits, attempts, out.each(k, event, us, hits))
        yield from out.batches(batch)
    if state is not None and not goes_on:
        out.ended(key, state)
    yield from out.batches(None)


def fold(events: DataFrame, keys: list[str], rule: Rule, make_out: Callable, schema: str, hot: int = HOT) -> DataFrame:
    """The fold of ``events`` (two keys, event_id, us, is_correct, attempts) with ordinary keys in one task each and
    hot keys over many. ``make_out()`` gives a gatherer of rows for a task."""
    order = [*keys, "us", "event_id"]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stretches(rule, batches, None, False, make_out())

    ordinary, many = split(events, keys, hot)
    rows = ordinary.repartition(*keys).sortWithinPartitions(*order).mapInArrow(plain, schema)
    return rows if many is None else rows.unionByName(_spread(many, order, rule, make_out, schema))


def split(events: DataFrame, keys: list[str], hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """(events of ordinary keys, events of keys with more than ``hot`` of them or None if there are none). The hot
    keys are counted with a partial sum in each task; there are at most one in ``hot`` events of them."""
    crowded = pinned(events.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > hot).drop("rows"))
    if crowded.isEmpty():
        return events, None
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    e, h = events.alias("e"), crowded.alias("h")
    return e.join(h, same, "left_anti"), e.join(h, same, "left_semi")


def spread(events: DataFrame, keys: list[str], rule: Rule, make_out: Callable, schema: str) -> DataFrame:
    """``fold`` of keys that are all hot."""
    return _spread(events, [*keys, "us", "event_id"], rule, make_out, schema)


def _spread(events: DataFrame, order: list[str], rule: Rule, make_out: Callable, schema: str) -> DataFrame:
    """``fold`` of hot keys."""
    # the number is kept in the rows: a union gives its partitions other ones
    rows = pinned(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    begin, unknown = State(rule.start, rule.start), State(rule.floor, rule.ceiling)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        part, blind, fresh, state = None, unknown, begin, None
        for batch in batches:
            part = number(batch) if part is None else part
            for key, (_, us, hits, attempts, _) in slices(batch):
                first = first or key
                if key == first:
                    blind, fresh = walk(rule, blind, us, hits, attempts), walk(rule, fresh, us, hits, attempts)
                else:
                    state = walk(rule, state if key == last and state else begin, us, hits, attempts)
                last = key
        if first:
            facts = pickle.dumps((first, last, blind, fresh, state))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([facts])], names=["part", "facts"])

    facts = {r["part"]: pickle.loads(r["facts"]) for r in rows.mapInArrow(probe, "part long, facts binary").collect()}  # a row a partition
    parts, ends, starts = sorted(facts), {}, {}
    while True:
        starts, waiting = _carried(parts, facts, ends, begin)
        if not waiting:
            break

        def again(batches: Iterator[pa.RecordBatch], at: dict = waiting) -> Iterator[pa.RecordBatch]:
            part = state = first = None
            for batch in batches:
                if part is None:
                    part = number(batch)
                    state = at.get(part)
                if state is None:
                    return
                for key, (_, us, hits, attempts, _) in slices(batch):
                    first = first or key
                    if key == first:
                        state = walk(rule, state, us, hits, attempts)
            if part is None:
                return
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps(state)])], names=["part", "state"])

        ends |= {r["part"]: pickle.loads(r["state"]) for r in rows.mapInArrow(again, "part long, state binary").collect()}
    on = {a for a, b in zip(parts, parts[1:], strict=False) if b in starts}

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next((b for b in batches if b.num_rows), None)
        if head is not None:
            part = number(head)
            yield from stretches(rule, itertools.chain([head], batches), starts.get(part), part in on, make_out())

    return rows.mapInArrow(last_pass, schema)


def _carried(parts: list[int], facts: dict, ends: dict, begin: State) -> tuple[dict[int, State], dict[int, State]]:
    """(the state that each partition's first key comes with, where the key began before; the partitions to walk again
    from a state, since what comes after them hangs on it)."""
    starts: dict[int, State] = {}
    waiting: dict[int, State] = {}
    key, state = None, None
    for i, part in enumerate(parts):
        first, last, blind, fresh, tail = facts[part]
        follows = i > 0 and first == key
        if follows and state is not None:
            starts[part] = state
        if last != first:
            key, state = last, tail
        elif not follows:
            key, state = first, fresh
        elif state is not None:
            known = ends.get(part) or blind.after(state)
            if known is None and i + 1 < len(parts) and facts[parts[i + 1]][0] == first:
                waiting[part] = state
            key, state = first, known
        # else: what comes before is still open; this key is taken up in a later round
    return starts, waiting
