"""Recurrences along ordered rows as scans of affine maps, within tasks by numpy and across tasks by totals of ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.graphs import _cut


def affine(a: np.ndarray, b: np.ndarray, start: float = 0.0) -> np.ndarray:
    """y with y[i] = a[i] * y[i - 1] + b[i] and y[-1] = `start`: maps are joined over 1, 2, 4, ... rows, until none reaches back."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a) and a[step:].any():
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step]
        step *= 2
    # Rows before `step` hold their whole map; for later ones it has come to forget the start, or is whole as well.
    return b + a * start


@dataclass
class Decay:
    """State of an exponentially weighted mean: sums of values and weights (or the mean and its weight), values seen, decays since the last one."""

    group: Any = None
    top: float = 0.0
    bottom: float = 0.0
    seen: int = 0
    gap: int = 0


@dataclass
class Part:
    """What a range of rows does to the state that comes into its first group."""

    number: int
    first: Any
    last: Any
    decays: int  # of the first group's rows here
    lead: int  # decays before its first value
    value: float | None  # its first value
    factor: float  # of the mean after its first value, recursive form
    end: Decay  # state after the range, from nothing


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted means: `adjust`ed by the sum of weights, or recursive; nulls weaken what was before, unless ignored."""

    alpha: float
    adjust: bool = True
    ignore_nulls: bool = False
    min_periods: int = 1

    def share(self, decays: np.ndarray | int) -> np.ndarray | float:
        """Weight of the old mean beside a new value, so many decays after the last one (recursive form)."""
        old = (1 - self.alpha) ** decays
        return old / (old + self.alpha)

    def step(self, group: np.ndarray, x: np.ndarray, state: Decay) -> tuple[np.ndarray, Decay, np.ndarray]:
        """(means, state after the rows, factors of the recursive form) of rows with numbers of groups; x is NaN for null.

        `state` goes on in the first row if that is of its group.
        """
        n, keep, has = len(x), 1 - self.alpha, ~np.isnan(x)
        fresh = np.concatenate([[group[0] != state.group], group[1:] != group[:-1]])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        carried = np.zeros(n, bool) if fresh[0] else begin == 0
        decays = has | ~np.full(n, self.ignore_nulls)
        count = np.cumsum(has)
        before = np.concatenate([[0], count])[begin]
        seen = count - before + np.where(carried, state.seen, 0)
        value = np.where(has, x, 0.0)
        if self.adjust:
            a = np.where(fresh, 0.0, np.where(decays, keep, 1.0))
            top, bottom = affine(a, value, state.top), affine(a, has.astype(float), state.bottom)
            factor = a
            mean = np.divide(top, bottom, out=np.full(n, np.nan), where=bottom > 0)
        else:
            passed = np.cumsum(decays)
            last = np.maximum.accumulate(np.where(has, np.arange(n), -1))
            previous = np.concatenate([[-1], last[:-1]])  # row of the last value before each row
            inside = previous >= begin
            since = passed - np.where(inside, passed[previous], np.where(begin > 0, passed[begin - 1], 0) - np.where(carried, state.gap, 0))
            known = inside | (carried & (state.seen > 0))
            share = np.where(known, self.share(since), 0.0)
            factor = np.where(has, share, np.where(fresh, 0.0, 1.0))
            top = affine(factor, np.where(has, (1 - share) * value, 0.0), state.top)
            bottom = np.ones(n)
            mean = np.where(seen > 0, top, np.nan)
            held = last >= begin
            gap = passed - np.where(held, passed[last], np.where(begin > 0, passed[begin - 1], 0) - np.where(carried, state.gap, 0))
        mean = np.where(seen >= max(1, self.min_periods), mean, np.nan)
        end = Decay(group[-1], float(top[-1]), float(bottom[-1]), int(seen[-1]), 0 if self.adjust else int(gap[-1]))
        return mean, end, factor

    def after(self, part: Part, state: Decay) -> Decay:
        """State after a range of one group that `state` came into."""
        if self.adjust:
            weight = (1 - self.alpha) ** part.decays
            return replace(part.end, top=weight * state.top + part.end.top, bottom=weight * state.bottom + part.end.bottom, seen=state.seen + part.end.seen)
        if part.value is None:
            return replace(state, gap=state.gap + part.decays)
        if not state.seen:
            return part.end
        share = float(self.share(state.gap + part.lead + 1))
        moved = share * state.top + (1 - share) * part.value - part.value  # against a first value alone
        return replace(part.end, top=part.end.top + part.factor * moved, seen=state.seen + part.end.seen)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("_group").to_numpy(zero_copy_only=False), batch.column("_value").to_numpy(zero_copy_only=False).astype(float)


def ewm_rows(ranged: DataFrame, rule: Ewm, out: str, starts: dict[int, Decay] | None = None) -> DataFrame:
    """Rows of `ranged`, sorted within partitions, with the mean `out`; `starts` has the state that comes into a partition (`_part`)."""
    kept = [f for f in ranged.schema if f.name not in ("_value", "_group", "_part")]
    schema = ranged.select([f.name for f in kept]).withColumn(out, F.lit(None).cast("double")).schema
    names = [f.name for f in kept]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = (starts or {}).get(batch.column("_part")[0].as_py(), Decay()) if starts else Decay()
            group, x = _numbers(batch)
            mean, state, _ = rule.step(group, x, state)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(mean, from_pandas=True)], names=[*names, out])

    return ranged.mapInArrow(task, schema)


def _parts(ranged: DataFrame, rule: Ewm) -> list[Part]:
    """A `Part` for each partition that has rows: a row a task, and no group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, Decay()
        for batch in batches:
            if not batch.num_rows:
                continue
            group, x = _numbers(batch)
            if part is None:
                part = Part(batch.column("_part")[0].as_py(), group[0], None, 0, 0, None, 1.0, state)
            _, state, factor = rule.step(group, x, state)
            mine = int(np.argmin(group == part.first)) if (group != part.first).any() else len(group)
            has = ~np.isnan(x[:mine])
            decays = has | (not rule.ignore_nulls)
            if mine:
                if part.value is None and has.any():
                    at = int(np.argmax(has))
                    part.lead, part.value, part.factor = part.decays + int(decays[:at].sum()), float(x[at]), float(np.prod(factor[at + 1 : mine]))
                elif part.value is not None:
                    part.factor *= float(np.prod(factor[:mine]))
                part.decays += int(decays.sum())
        if part is not None:
            row = {"number": part.number, "first": part.first, "last": state.group, "decays": part.decays, "lead": part.lead, "value": part.value, "factor": part.factor}
            row |= {"top": state.top, "bottom": state.bottom, "seen": state.seen, "gap": state.gap}
            yield pa.RecordBatch.from_pylist([row])

    kind = "number long, first string, last string, decays long, lead long, value double, factor double, top double, bottom double, seen long, gap long"
    rows = ranged.select("_group", "_value", "_part").mapInArrow(task, kind).collect()
    return [Part(r.number, r.first, r.last, r.decays, r.lead, r.value, r.factor, Decay(r.last, r.top, r.bottom, r.seen, r.gap)) for r in sorted(rows, key=lambda r: r.number)]


def _starts(parts: Sequence[Part], rule: Ewm) -> dict[int, Decay]:
    starts, state = {}, Decay()
    for p in parts:
        if state.group is not None and state.group == p.first:
            starts[p.number] = state
            state = rule.after(p, state) if p.first == p.last else p.end
        else:
            state = p.end
    return starts


def ewm_of(df: DataFrame, value: Column, partition_by: Sequence[str], order: Sequence[Column], rule: Ewm, out: str, ranges: int = 0) -> DataFrame:
    """`df` with the mean `out` of `value` along each partition.

    With `ranges`, rows are dealt by ranges of partition and order, so that the rows of one key lie in several tasks:
    each range is summed up in one row, the driver goes through these rows (as many as there are ranges), and each range
    is gone through with the state that comes into it. Without, a partition's rows are in one task.
    """
    keys = [F.col(k) for k in partition_by]
    given = df.withColumns({"_value": value.cast("double"), "_group": F.to_json(F.struct(*partition_by)) if keys else F.lit("")})
    if not ranges:
        sorted_rows = (given.repartition(*keys) if keys else given.coalesce(1)).sortWithinPartitions(*keys, *order)
        return ewm_rows(sorted_rows, rule, out)
    ranged = given.repartitionByRange(ranges, "_group", *order).sortWithinPartitions("_group", *order)
    ranged = _cut(ranged.withColumn("_part", F.spark_partition_id()))
    return ewm_rows(ranged, rule, out, _starts(_parts(ranged, rule), rule))
