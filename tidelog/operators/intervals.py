"""Interval-shaped fragments of sessions: coverage, gaps, windows, ingestion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds after which a gap is given up, the least and the most overlap of windows, and the longest window.
GAP_AGE, MIN_OVERLAP, MAX_OVERLAP, MAX_WINDOW = 30_000, 10_000, 60_000, 20 * 60_000
#: Bytes of audio in a window, at most.
MAX_BYTES = 40 * 1024 * 1024


def _coverage() -> Window:
    return Window.partitionBy("session_id").orderBy("start_ms", "sequence").rowsBetween(Window.unboundedPreceding, -1)


def candidates(fragments: DataFrame, watermark: Column, deadline: Column) -> DataFrame:
    """Fragments that reach beyond the watermark and begin before the deadline."""
    return fragments.where((F.col("end_ms") > watermark) & (F.col("start_ms") < deadline))


def with_coverage(fragments: DataFrame, watermark: Column) -> DataFrame:
    """Add ``covered``: how far the session is covered before each fragment, from the watermark on."""
    return fragments.withColumn("covered", F.greatest(F.coalesce(F.max("end_ms").over(_coverage()), watermark), watermark))


def find_gaps(fragments: DataFrame, watermark: Column) -> DataFrame:
    """Gaps in the coverage of each session: ``session_id``, ``start_ms``, ``end_ms``."""
    return with_coverage(fragments, watermark).where("start_ms > covered").select("session_id", F.col("covered").alias("start_ms"), F.col("start_ms").alias("end_ms"))


def scan_gaps(fragments: DataFrame, sessions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Progress of each session, and its gaps afterwards.

    ``sessions`` has session_id, watermark_ms, deadline_ms, now_ms; ``known`` gaps
    session_id, start_ms, end_ms, first_observed_ms, status. A gap waits until it is
    GAP_AGE old, then it is given up and crossed. The first waiting gap blocks.
    Progress: ``processable_end``, ``blocked``, ``degraded`` per session.
    """
    own = fragments.join(sessions, "session_id")
    rows = with_coverage(own.where("end_ms > watermark_ms and start_ms < deadline_ms"), F.col("watermark_ms"))
    gaps = rows.where("start_ms > covered").select("session_id", F.col("covered").alias("gap_start"), F.col("start_ms").alias("gap_end"), "watermark_ms", "now_ms")
    old = known.select("session_id", F.col("start_ms").alias("gap_start"), F.col("first_observed_ms").alias("_first"), F.col("status").alias("_status"))
    first = F.coalesce("_first", F.col("now_ms"))
    given_up = F.coalesce(F.col("_status") == "abandoned", F.lit(False)) | (F.col("now_ms") - first >= GAP_AGE)
    judged = gaps.join(old, ["session_id", "gap_start"], "left").withColumn("first_observed_ms", first).withColumn("status", F.when(given_up, "abandoned").otherwise("waiting"))
    stop = judged.groupBy("session_id").agg(F.min(F.when(F.col("status") == "waiting", F.col("gap_start"))).alias("stop"), F.min(F.when(F.col("status") == "abandoned", F.col("gap_start"))).alias("crossed"))
    reach = rows.groupBy("session_id").agg(F.max("end_ms").alias("_end"))
    progress = sessions.join(reach, "session_id", "left").join(stop, "session_id", "left").select(
        "session_id",
        F.least("deadline_ms", F.coalesce("stop", F.greatest("_end", "watermark_ms"), "watermark_ms")).alias("processable_end"),
        F.coalesce(F.col("stop") == F.col("watermark_ms"), F.lit(False)).alias("blocked"),
        F.coalesce(F.col("crossed").isNotNull() & (F.col("stop").isNull() | (F.col("crossed") < F.col("stop"))), F.lit(False)).alias("degraded"),
    )
    met = judged.join(stop.select("session_id", "stop"), "session_id").where("stop is null or gap_start <= stop").select("session_id", F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"), "first_observed_ms", "status")
    later = known.join(progress.select("session_id", "processable_end"), "session_id", "left").where("processable_end is null or start_ms >= processable_end").select("session_id", "start_ms", "end_ms", "first_observed_ms", "status")
    return progress, met.unionByName(later.join(met.select("session_id", "start_ms"), ["session_id", "start_ms"], "left_anti").select(*met.columns))


def plan_window(watermark: Column, end: Column, previous_new_ms: Column) -> Column:
    """Window of the next pull: it overlaps what is done by as much as was new last time, within bounds, and is capped in length."""
    overlap = F.greatest(F.lit(MIN_OVERLAP), F.least(F.greatest(previous_new_ms, F.lit(0)), F.lit(MAX_OVERLAP)))
    start = F.greatest(F.lit(0), watermark - overlap)
    return F.struct(start.alias("start_ms"), F.least(end, start + MAX_WINDOW).alias("end_ms"), overlap.alias("overlap_ms"))


def budget_ms(sample_rate: Column, channels: Column, bit_depth: Column, most: int = MAX_BYTES) -> Column:
    """Milliseconds of audio that fit into a number of bytes."""
    return F.floor(F.lit(most) * 1000 / (sample_rate * channels * bit_depth / 8)).cast("bigint")


def clip_segments(fragments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Parts of a window that each fragment adds: ``from_ms``, ``to_ms``, without what others before it cover."""
    rows = with_coverage(fragments, start)
    cut = rows.withColumn("from_ms", F.greatest("start_ms", "covered", start)).withColumn("to_ms", F.least(F.col("end_ms"), end))
    return cut.where("to_ms > from_ms").select("session_id", "sequence", "from_ms", "to_ms")


def silence_segments(fragments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Parts of a window that no fragment covers: before, between and after them."""
    segments = clip_segments(fragments, start, end)
    order = Window.partitionBy("session_id").orderBy("from_ms")
    ahead = segments.withColumn("_from", F.coalesce(F.lag("to_ms").over(order), start)).where("from_ms > _from").select("session_id", F.col("_from").alias("from_ms"), F.col("from_ms").alias("to_ms"))
    last = segments.groupBy("session_id").agg(F.max("to_ms").alias("from_ms")).withColumn("to_ms", end).where("to_ms > from_ms")
    return ahead.unionByName(last)


def ingest(stored: DataFrame, incoming: DataFrame, watermarks: DataFrame) -> DataFrame:
    """What happens to incoming fragments: ``status`` new, duplicate_no_op, duplicate_rejected or replaced.

    The same content and times as stored change nothing; other content is rejected
    if the stored fragment begins before the watermark, else it replaces it and
    keeps the first time of ingestion.
    """
    keys = ["session_id", "sequence"]
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("start_ms", "end_ms", "content_hash", "ingested_at_ms")])
    both = incoming.join(old, keys, "left").join(watermarks, "session_id", "left")
    same = (F.col("content_hash") == F.col("_content_hash")) & (F.col("start_ms") == F.col("_start_ms")) & (F.col("end_ms") == F.col("_end_ms"))
    status = F.when(F.col("_start_ms").isNull(), "new").when(same, "duplicate_no_op").when(F.col("_start_ms") < F.coalesce("watermark_ms", F.lit(0)), "duplicate_rejected").otherwise("replaced")
    return both.select(*keys, status.alias("status"), F.coalesce("_ingested_at_ms", "ingested_at_ms").alias("ingested_at_ms"))


def session_rollup(fragments: DataFrame) -> DataFrame:
    """Per session: fragments, last sequence, the end of that fragment, seconds elapsed (rounded up)."""
    return fragments.groupBy("session_id").agg(
        F.count("*").alias("n_fragments"),
        F.max("sequence").alias("last_sequence"),
        F.max_by("end_ms", "sequence").alias("last_end_ms"),
        F.ceil(F.max_by("end_ms", "sequence") / 1000).cast("bigint").alias("elapsed_seconds"),
    )


def last_range(fragments: DataFrame) -> DataFrame:
    """First start, last end (by order, not by size) and number of fragments of each session."""
    order = F.struct("start_ms", "sequence")
    return fragments.groupBy("session_id").agg(F.min_by("start_ms", order).alias("first_start_ms"), F.max_by("end_ms", order).alias("last_end_ms"), F.count("*").alias("n"))


def bytes_aligned(ms: Column, sample_rate: int = 16_000, channels: int = 1, bit_depth: int = 16, up: bool = False) -> Column:
    """Bytes of so many milliseconds, in whole frames, rounded down or up."""
    frame = channels * bit_depth // 8
    frames = ms * sample_rate / 1000
    return ((F.ceil(frames) if up else F.floor(frames)) * frame).cast("bigint")


def questions_fetched(asked: DataFrame, fetches: DataFrame) -> DataFrame:
    """Each question (``session_id``, ``at``, ``text``) with ``fetched_at``, the session's first fetch at or after it; null while it is pending.

    A fetch takes all pending questions of its session and leaves none, so every question is in one fetch.
    """
    both = asked.select("session_id", "at", "text", F.lit(0).alias("_fetch")).unionByName(fetches.select("session_id", "at", F.lit(None).cast("string").alias("text"), F.lit(1).alias("_fetch")))
    later = Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("_fetch")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("fetched_at", F.last(F.when(F.col("_fetch") == 1, F.col("at")), ignorenulls=True).over(later)).where("_fetch = 0").drop("_fetch")
