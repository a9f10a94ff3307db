"""Sessions as they go on: proof that a recorder lives, and reports that grow while it records.

State is held per recording and bounded: a few numbers for its pulse, and for a report a row per finding with its first pieces of
evidence. It goes when the session ends, or when its timer says that it has died.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spoor.catalog import Catalog
from spoor.operators import rules

#: A heartbeat is due after so many events or so much time, whichever comes first.
BEAT_EVENTS, BEAT_US = 2_000, 2_000_000
PULSE = "recording_id long, kind string, beats long, events long, us long"


@dataclass
class Pulse:
    """What is known of a session's life so far."""

    events: int = 0
    beats: int = 0
    beat_events: int = 0
    beat_us: int = 0
    last_us: int = 0
    dead: bool = False

    def step(self, us: int, end: bool, every: int, every_us: int, limit_us: int) -> Iterator[tuple]:
        """One event: ``dead`` if it comes after a silence of more than the limit, ``heartbeat`` if one is due, ``ended`` for the last."""
        if self.events and not self.dead and us - self.last_us > limit_us:
            yield self.died()
        if not self.events:
            self.beat_us = us
        self.last_us = max(us, self.last_us) if self.events else us
        if end:
            yield ("ended", self.beats, self.events, us)
            return
        self.events += 1
        if self.events - self.beat_events >= every or us - self.beat_us >= every_us:
            self.beats, self.beat_events, self.beat_us = self.beats + 1, self.events, us
            yield ("heartbeat", self.beats, self.events, us)

    def died(self) -> tuple:
        self.dead = True
        return ("dead", self.beats, self.events, self.last_us)

    def due_ms(self, limit_us: int) -> int:
        """The first millisecond at which the silence is over the limit."""
        return (self.last_us + limit_us) // 1000 + 1


def _rows(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    return sorted((int(u), int(a), bool(e)) for b in batches for u, a, e in zip(b["us"], b["arrival"], b["is_end"], strict=True))


def pulses(events: DataFrame, limit_us: int, every: int = BEAT_EVENTS, every_us: int = BEAT_US) -> DataFrame:
    """A stream ``recording_id, us, arrival, is_end`` with a watermark on ``time`` to the rows of ``PULSE``. A recording whose events stop
    for more than ``limit_us`` before its end is dead: it is partial. A timer in event time tells so even if nothing more arrives. The dead
    are remembered until an end arrives, so that each is told once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pulse = Pulse(*state.get) if state.exists else Pulse()
        out, ended = [], False
        if state.hasTimedOut:
            if not pulse.dead:
                out.append(pulse.died())
        else:
            for us, _, end in _rows(batches):
                out += pulse.step(us, end, every, every_us, limit_us)
                ended = ended or end
        if not ended and not pulse.dead and pulse.due_ms(limit_us) <= state.getCurrentWatermarkMs():
            out.append(pulse.died())
        if ended:
            state.remove()
        else:
            state.update((pulse.events, pulse.beats, pulse.beat_events, pulse.beat_us, pulse.last_us, pulse.dead))
            if not pulse.dead:
                state.setTimeoutTimestamp(pulse.due_ms(limit_us))
        yield pd.DataFrame([(*key, *r) for r in out], columns=["recording_id", "kind", "beats", "events", "us"])

    held = "events long, beats long, beat_events long, beat_us long, last_us long, dead boolean"
    return events.groupBy("recording_id").applyInPandasWithState(step, PULSE, held, "append", GroupStateTimeout.EventTimeTimeout)


def pulses_of(events: DataFrame, limit_us: int, every: int = BEAT_EVENTS, every_us: int = BEAT_US) -> DataFrame:
    """The same of whole recordings; the newest event of all is what time it is. A recording is one group, which the event cap bounds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pulse, out, ended = Pulse(), [], False
        for us, _, end in _rows(iter([rows])):
            out += pulse.step(us, end, every, every_us, limit_us)
            ended = ended or end
        if not ended and not pulse.dead and pulse.due_ms(limit_us) < int(rows["now"].iloc[0]) // 1000:
            out.append(pulse.died())
        return pd.DataFrame([(rows["recording_id"].iloc[0], *r) for r in out], columns=["recording_id", "kind", "beats", "events", "us"])

    now = events.agg(F.max("us").alias("now"))
    return events.select("recording_id", "us", "arrival", "is_end").crossJoin(F.broadcast(now)).groupBy("recording_id").applyInPandas(run, PULSE)


EVIDENCE = "seq long, ts_ns long, pid long, op string, detail string"
REPORT = f"recording_id long, rule_id string, subject string, severity string, sev_rank int, title string, occurrences long, evidence array<struct<{', '.join(x.replace(' ', ': ') for x in EVIDENCE.split(', '))}>>, observations long, unresolved long, backend string, is_partial boolean"


def live_reports(events: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """A stream of placed events to the rows of reports that changed: findings with their count, worst severity and first evidence, and
    for each recording a row without a rule, with its observations and whether it is partial (until an end says complete). A recording's
    state goes with its ``session_end``. ``upserts`` keeps them."""
    catalog = catalog or Catalog()
    c = F.col
    matched = rules.match_rules(rules.hits(events, catalog), catalog).select("recording_id", "seq", "ts_ns", "pid", "op", "detail", "rule_id", "subject", "severity", "sev_rank", "title", "backend")
    lost = (c("op") == "fs_write") & (c("placement") == "unresolvable")
    seen = rules.placed(events).select("recording_id", "seq", "op", "backend", (~c("op").isin(*rules.FRAMING)).alias("observed"), lost.alias("unresolved"), F.when(c("op") == "session_end", F.coalesce("complete", F.lit(False))).alias("ended"))
    whole = lambda x: None if pd.isna(x) else int(x)
    fields = [x.split()[0] for x in REPORT.split("array<")[0].split(", ")[:7]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"found": {}, "observations": 0, "unresolved": 0, "backend": None, "first": None}
        found, changed, ended = held["found"], set(), None
        for row in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.seq):
            if not isinstance(row.rule_id, str):
                held["observations"] += bool(row.observed)
                held["unresolved"] += row.unresolved is not None and not pd.isna(row.unresolved) and bool(row.unresolved)
                if isinstance(row.backend, str) and (held["first"] is None or row.seq < held["first"]):
                    held["first"], held["backend"] = int(row.seq), row.backend
                if row.ended is not None and not pd.isna(row.ended):
                    ended = bool(row.ended)
                continue
            name = json.dumps([row.rule_id, row.subject])
            one = found.setdefault(name, {"n": 0, "worst": None, "evidence": []})
            one["n"] += 1
            worst = [int(row.sev_rank), row.severity, row.title]
            one["worst"] = worst if one["worst"] is None else min(one["worst"], worst)
            piece = [int(row.seq), whole(row.ts_ns), whole(row.pid), row.op, row.detail if isinstance(row.detail, str) else None]
            one["evidence"] = sorted([*one["evidence"], piece], key=lambda p: p[0])[: rules.EVIDENCE]
            changed.add(name)
        out = [(*key, None, None, None, None, None, None, None, held["observations"], held["unresolved"], held["backend"], not ended)]
        for name in sorted(changed):
            (rule_id, subject), one = json.loads(name), found[name]
            rank, severity, title = one["worst"]
            pieces = [dict(zip(("seq", "ts_ns", "pid", "op", "detail"), p, strict=True)) for p in one["evidence"]]
            out.append((*key, rule_id, subject, severity, rank, f"{title}: {subject}", one["n"], pieces, None, None, None, None))
        if ended is None:
            state.update((json.dumps(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*fields, "evidence", "observations", "unresolved", "backend", "is_partial"])

    both = seen.unionByName(matched.drop("backend"), allowMissingColumns=True)
    return both.groupBy("recording_id").applyInPandasWithState(step, REPORT, "held string", "update", GroupStateTimeout.NoTimeout)


def upserts(path: str):
    """A sink for ``foreachBatch``: each batch of changed rows under its number. A batch that is repeated after a failure takes the
    place of its first attempt, so it changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return keep


def latest(spark, path: str) -> DataFrame:
    """The last state of every row that ``upserts`` kept."""
    rows = spark.read.schema(REPORT + ", batch long").parquet(path)
    names = [x for x in rows.columns if x != "batch"]
    return rows.groupBy("recording_id", "rule_id", "subject").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")


def reports(state: DataFrame) -> DataFrame:
    """Of ``latest`` rows the score and verdict of each recording, as of a finished one by ``evaluate``."""
    recordings = state.where("rule_id is null").select("recording_id", "observations", "unresolved", "backend", (~F.col("is_partial")).alias("complete"), F.lit(True).alias("has_end"))
    scored = rules.scores(recordings.select("recording_id"), state.where("rule_id is not null"))
    rows = recordings.join(scored, "recording_id")
    return rows.select("recording_id", "observations", "unresolved", "backend", *rules.SEVERITIES, "raw", "value", rules.is_partial().alias("is_partial"), rules.verdict().alias("verdict"))
