"""Alert rules over events: measures of windows that end at evaluation times, thresholds, and suppression of repeats.

Rules are evaluated at all multiples of `every` seconds. What is reported of a rule, a group of its dimensions and an
evaluation time: insufficient_samples, ok, triggered, or suppressed: triggered again too soon.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALL = "__all__"
METRICS = ("count", "error_count", "error_rate", "p95_duration_ms", "avg_duration_ms")
OPERATORS = ("gt", "gte", "lt", "lte", "eq", "neq")
MICROS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A rule: looks back `window` seconds; a repeat within `suppression` seconds of the last trigger is suppressed.

    `where` is a condition as SQL text.
    """

    id: str
    metric: str = "error_count"
    operator: str = "gte"
    threshold: float = 1
    window: int = 300
    suppression: int = 300
    min_samples: int = 1
    dimensions: tuple[str, ...] = ()
    where: str | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.metric not in METRICS or self.operator not in OPERATORS:
            raise ValueError(f"rule {self.id}: metric is one of {METRICS}, operator one of {OPERATORS}")
        if self.window < 1 or self.suppression < 0 or self.min_samples < 0:
            raise ValueError(f"rule {self.id}: negative time or number")

    def group(self) -> Column:
        """Name of an event's group: its dimensions as name=value (null: empty), joined by bars."""
        if not self.dimensions:
            return F.lit(ALL)
        return F.concat_ws("|", *[F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in self.dimensions])


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _usable(rules: Sequence[Rule]) -> list[Rule]:
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("ids of rules are not distinct")
    return [r for r in rules if r.enabled]


def _samples(events: DataFrame, rules: Sequence[Rule], ts: str, every: int, duration: str, is_error: Column, last: Column | None, keep: str | None = None) -> DataFrame:
    """rule_id, group_key, _at (number of the evaluation), _error and _value: an event for each window that has it, both ends included."""
    at, step = _micros(ts), every * MICROS
    places = []
    for r in rules:
        high = F.floor((at + r.window * MICROS) / step)
        kept = F.col(ts).isNotNull() & (F.coalesce(F.expr(r.where), F.lit(False)) if r.where else F.lit(True))
        place = F.struct(F.lit(r.id).alias("rule_id"), r.group().alias("group_key"), F.ceil(at / step).alias("low"), (high if last is None else F.least(high, last)).alias("high"))
        places.append(F.when(kept & (place["low"] <= place["high"]), place))
    kept_too = [keep] if keep else []
    found = events.select(*kept_too, F.explode(F.array_compact(F.array(*places))).alias("_p"), F.coalesce(is_error, F.lit(False)).alias("_error"), F.col(duration).cast("double").alias("_value"))
    return found.select(*kept_too, "_p.rule_id", "_p.group_key", F.explode(F.sequence("_p.low", "_p.high")).alias("_at"), "_error", F.when(~F.isnan("_value"), F.col("_value")).alias("_value"))


def _measures(rules: Sequence[Rule]) -> list[Column]:
    tail = F.percentile("_value", 0.95) if any(r.metric == "p95_duration_ms" for r in rules) else F.lit(None).cast("double")
    return [F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("_error")).alias("_errors"), F.avg("_value").alias("_mean"), tail.alias("_tail")]


def _judged(measured: DataFrame, rules: Sequence[Rule], every: int) -> DataFrame:
    """rule_id, group_key, evaluated_at, status (triggered before any suppression), value, sample_size."""
    errors, n = F.col("_errors").cast("double"), F.col("sample_size").cast("double")
    rate = F.when(n == 0, 0.0).otherwise(errors / n * 100)
    of = {"count": n, "error_count": errors, "error_rate": rate, "p95_duration_ms": F.col("_tail"), "avg_duration_ms": F.col("_mean")}
    value, least, hit = F.lit(None).cast("double"), F.lit(0), F.lit(False)
    for r in rules:
        mine, x = F.col("rule_id") == r.id, of[r.metric]
        tests = {"gt": x > r.threshold, "gte": x >= r.threshold, "lt": x < r.threshold, "lte": x <= r.threshold, "eq": x == r.threshold, "neq": x != r.threshold}
        value, least, hit = F.when(mine, x).otherwise(value), F.when(mine, r.min_samples).otherwise(least), F.when(mine, F.coalesce(tests[r.operator], F.lit(False))).otherwise(hit)
    few = F.col("sample_size") < least
    status = F.when(few, "insufficient_samples").when(hit, "triggered").otherwise("ok")
    return measured.select("rule_id", "group_key", F.timestamp_micros(F.col("_at") * (every * MICROS)).alias("evaluated_at"), status.alias("status"), F.when(~few, value).alias("value"), F.col("sample_size").cast("long"))


def suppress(times: Iterable[int], suppression: int, last: int | None = None) -> tuple[list[int | None], int | None]:
    """(until, last): for each rising time of a trigger, None if it goes off or the end of the suppression it falls in; time of the last that did."""
    until: list[int | None] = []
    for t in times:
        free = last is None or t - last >= suppression
        until.append(None if free else last + suppression)
        last = t if free else last
    return until, last


def evaluate(events: DataFrame, rules: Sequence[Rule], ts: str, duration: str, is_error: Column, every: int) -> DataFrame:
    """rule_id, group_key, evaluated_at, status, value, sample_size, suppressed_until of all evaluations that cover `events`.

    Evaluation times run from the first multiple of `every` seconds at or after the first event to that of the last one.
    A window without any event of a rule has one row for the group __all__ of no samples. Events without a time and
    values that are null or not numbers are left out. Windows are summed before the shuffle; triggers of a rule and
    group are then gone through in order of time.
    """
    rules = _usable(rules)
    out = "rule_id string, group_key string, evaluated_at timestamp, status string, value double, sample_size long, suppressed_until timestamp"
    first, last = events.agg(F.min(_micros(ts)), F.max(_micros(ts))).first()
    spark, step = events.sparkSession, every * MICROS
    if not rules or first is None:
        return spark.createDataFrame([], out)
    first, last = -(-first // step), -(-last // step)
    measured = _samples(events, rules, ts, every, duration, is_error, F.lit(last)).groupBy("rule_id", "group_key", "_at").agg(*_measures(rules))
    grid = spark.range(first, last + 1).select(F.explode(F.array(*[F.lit(r.id) for r in rules])).alias("rule_id"), F.col("id").alias("_at"))
    quiet = grid.join(measured.select("rule_id", "_at").distinct(), ["rule_id", "_at"], "left_anti")
    quiet = quiet.select("rule_id", F.lit(ALL).alias("group_key"), "_at", F.lit(0).cast("long").alias("sample_size"), F.lit(0).cast("long").alias("_errors"), F.lit(None).cast("double").alias("_mean"), F.lit(None).cast("double").alias("_tail"))
    judged = _judged(measured.unionByName(quiet), rules, every)
    pause = {r.id: r.suppression * MICROS for r in rules}

    def go_through(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending")])
        until, _ = suppress(rows.column("at").to_pylist(), pause[rows.column("rule_id")[0].as_py()])
        return rows.append_column("until", pa.array(until, pa.int64()))

    hits = judged.filter("status = 'triggered'").select("rule_id", "group_key", F.unix_micros("evaluated_at").alias("at"), "value", "sample_size")
    hits = hits.groupBy("rule_id", "group_key").applyInArrow(go_through, "rule_id string, group_key string, at long, value double, sample_size long, until long")
    state = F.when(F.col("until").isNull(), "triggered").otherwise("suppressed").alias("status")
    hits = hits.select("rule_id", "group_key", F.timestamp_micros("at").alias("evaluated_at"), state, "value", "sample_size", F.timestamp_micros("until").alias("suppressed_until"))
    return judged.filter("status != 'triggered'").withColumn("suppressed_until", F.lit(None).cast("timestamp")).unionByName(hits)


class Pending:
    """Windows of a rule and group that can still get events, and the last trigger: the state of a stream."""

    def __init__(self, rule: Rule, text: str | None = None):
        self.rule = rule
        self.last, self.open = json.loads(text) if text else (None, {})

    def add(self, at: int, is_error: bool, value: float) -> None:
        window = self.open.setdefault(str(at), [0, 0, 0, 0.0, []])
        window[0] += 1
        window[1] += bool(is_error)
        if value == value:  # neither null nor NaN
            window[2] += 1
            window[3] += value
            if self.rule.metric == "p95_duration_ms":
                window[4].append(value)

    def close(self, before: int) -> list[tuple]:
        """(at, status, value, sample_size, suppressed_until) of windows that end before a time, in order; they leave the state."""
        done = sorted(int(k) for k in self.open if int(k) < before)
        return [(at, *self._judge(at, *self.open.pop(str(at)))) for at in done]

    def _judge(self, at: int, n: int, errors: int, known: int, total: float, values: list[float]) -> tuple:
        rule = self.rule
        if n < rule.min_samples:
            return "insufficient_samples", None, n, None
        rate, mean = 100 * errors / n, total / known if known else None
        tail = float(np.percentile(values, 95)) if values else None
        value = {"count": float(n), "error_count": float(errors), "error_rate": rate, "p95_duration_ms": tail, "avg_duration_ms": mean}[rule.metric]
        if value is None or not getattr(operator, {"gt": "gt", "gte": "ge", "lt": "lt", "lte": "le", "eq": "eq", "neq": "ne"}[rule.operator])(value, rule.threshold):
            return "ok", value, n, None
        (until,), self.last = suppress([at], rule.suppression * MICROS, self.last)
        return "triggered" if until is None else "suppressed", value, n, until

    def text(self) -> str:
        return json.dumps((self.last, self.open))


def evaluate_stream(events: DataFrame, rules: Sequence[Rule], ts: str, duration: str, is_error: Column, every: int, late: int = 0) -> DataFrame:
    """`evaluate` of a stream, in append mode: an evaluation is reported once the watermark (`late` seconds behind) has passed it.

    Each rule and group keeps its open windows and its last trigger as state, so suppression goes on over batches and
    restarts. Events of closed windows are dropped; windows without any event of a rule are not reported.
    """
    rules = _usable(rules)
    by_id = {r.id: r for r in rules}
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{late} seconds")
    samples = _samples(timed, rules, ts, every, duration, is_error, None, keep=ts)

    def go_through(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, watermark = Pending(by_id[key[0]], state.get[0] if state.exists else None), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for rows in batches:
                fresh = rows[rows["_at"] * (every * 1000) >= watermark]
                for at, is_error_, value in zip(fresh["_at"], fresh["_error"], fresh["_value"].astype("float64")):
                    held.add(int(at) * every * MICROS, is_error_, value)
        closed = held.close(watermark * 1000)
        state.update((held.text(),))
        if held.open:
            state.setTimeoutTimestamp(max(min(map(int, held.open)) // 1000, watermark) + 1)
        if not closed:
            return
        frame = pd.DataFrame(closed, columns=["at", "status", "value", "sample_size", "until"]).astype({"until": "Int64", "value": "Float64"})
        yield frame.assign(rule_id=key[0], group_key=key[1])[["rule_id", "group_key", "at", "status", "value", "sample_size", "until"]]

    kinds = "rule_id string, group_key string, at long, status string, value double, sample_size long, until long"
    done = samples.groupBy("rule_id", "group_key").applyInPandasWithState(go_through, kinds, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("rule_id", "group_key", F.timestamp_micros("at").alias("evaluated_at"), "status", "value", "sample_size", F.timestamp_micros("until").alias("suppressed_until"))
