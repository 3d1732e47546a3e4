"""Structured Streaming forms of fragment ingestion and of the gap scan, with state per session.

Timers go by the fragments' time of ingestion: its watermark moves with any session's
fragments, so the gap of a silent session ages as well, and a stream that has read
all its input ends (timers by the clock would start batches for ever).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.intervals import GAP_AGE

FRAGMENT = "session_id bigint, sequence bigint, start_ms bigint, end_ms bigint, content_hash string, ingested_at_ms bigint"
_INGEST = "session_id bigint, sequence bigint, status string, ingested_at_ms bigint"
_PROGRESS = "session_id bigint, watermark_ms bigint, status string, abandoned_gaps int"
_STATE = "watermark_ms bigint, starts array<bigint>, ends array<bigint>, gap_start_ms bigint, gap_seen_ms bigint"
#: Milliseconds after a fragment until its state ends.
KEPT = 24 * 3600 * 1000


def _timed(fragments: DataFrame, late: str) -> DataFrame:
    return fragments.withColumn("_at", F.timestamp_millis("ingested_at_ms")).withWatermark("_at", late)


def ingest_stream(fragments: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Status of each fragment of a stream: new, duplicate_no_op, duplicate_rejected or replaced, keyed by session and sequence.

    Where ``fragments`` has ``watermark_ms``, its session's (joined to the stream from a
    table), other content is rejected if the known fragment begins before it. State is
    one small row per (session, sequence): its times, hash and first time of
    ingestion. It ends a day after the last fragment under that key. Fragments that
    are ``late`` still count while their state is there.
    """
    marks = F.coalesce("watermark_ms", F.lit(0)) if "watermark_ms" in fragments.columns else F.lit(0)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ingested_at_ms", kind="stable")
        out, last = [], 0
        for r in rows.itertuples():
            now, last = (int(r.start_ms), int(r.end_ms), str(r.content_hash)), int(r.ingested_at_ms)
            if known is None:
                status, known = "new", (*now, last)
            elif tuple(known[:3]) == now:
                status = "duplicate_no_op"
            elif known[0] < int(r.watermark_ms):
                status = "duplicate_rejected"
            else:
                status, known = "replaced", (*now, known[3])
            out.append((key[0], key[1], status, known[3]))
        state.update(known)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + KEPT)
        yield pd.DataFrame(out, columns=["session_id", "sequence", "status", "ingested_at_ms"])

    kept = "start_ms bigint, end_ms bigint, content_hash string, first_ms bigint"
    rows = _timed(fragments.withColumn("watermark_ms", marks.cast("bigint")), late)
    return rows.groupBy("session_id", "sequence").applyInPandasWithState(step, _INGEST, kept, "append", GroupStateTimeout.EventTimeTimeout)


def gap_stream(fragments: DataFrame, gap_age_ms: int = GAP_AGE, late: str = "0 seconds") -> DataFrame:
    """Progress of each session of a stream: its watermark, and ok, blocked or degraded.

    The watermark goes as far as fragments cover the session without a gap. A gap
    holds it until the gap is filled, or ``gap_age_ms`` have gone by since it was seen
    (by the time of ingestion of this or any other session's fragments); then it is
    crossed. Only fragments beyond the watermark are in the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, starts, ends, gap, seen = state.get if state.exists else (0, [], [], -1, -1)
        spans, now = list(zip(starts, ends, strict=True)), seen
        if state.hasTimedOut:
            now = max(now, state.getCurrentWatermarkMs())
        else:
            for batch in batches:
                spans += [(int(a), int(b)) for a, b in zip(batch.start_ms, batch.end_ms, strict=True)]
                now = max(now, int(batch.ingested_at_ms.max()))
        status, crossed, left = "ok", 0, []
        if not state.exists and spans:
            mark = min(a for a, _ in spans)
        for a, b in sorted(spans):
            if left:
                left.append((a, b))
                continue
            if a > mark:
                if gap != mark:
                    gap, seen = mark, now
                if now - seen < gap_age_ms:
                    status = "blocked"
                    left.append((a, b))
                    continue
                crossed += 1
            mark = max(mark, b)
        if crossed and status == "ok":
            status = "degraded"
        if not left:
            gap = seen = -1
        state.update((mark, [a for a, _ in left], [b for _, b in left], gap, seen))
        if left:
            state.setTimeoutTimestamp(max(seen + gap_age_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], mark, status, crossed)], columns=["session_id", "watermark_ms", "status", "abandoned_gaps"])

    return _timed(fragments, late).groupBy("session_id").applyInPandasWithState(step, _PROGRESS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
