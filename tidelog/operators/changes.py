"""Change logs, store differences and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources.shared import settle

ADD, EDIT, DELETE = "add", "edit", "delete"


def _values(df: DataFrame, key: str, order: str | None) -> Column:
    """All columns but key and order, to be compared as values (nulls equal)."""
    return F.struct(*[F.col(c) for c in df.columns if c not in (key, order)])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Changes that lead from one snapshot to another: ``action``, ``id``, ``rank`` and the row's values as ``event``.

    An id that is new is added, one with other values edited, one that is gone
    deleted; unchanged ids give no row. ``rank`` is the order within the change
    log: additions and edits by the new order, then deletions by the old one.
    """
    a = old.select(F.col(key), F.col(order).alias("_old"), _values(old, key, order).alias("_a"))
    b = new.select(F.col(key), F.col(order).alias("_new"), _values(new, key, order).alias("_b"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("_old").isNull(), ADD).when(F.col("_new").isNull(), DELETE).when(~F.col("_a").eqNullSafe(F.col("_b")), EDIT)
    rank = F.struct((F.col("_new").isNull()).alias("gone"), F.coalesce("_new", "_old").alias("at"))
    return both.select(action.alias("action"), key, rank.alias("rank"), F.coalesce("_b", "_a").alias("event")).where("action is not null")


def is_unchanged(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> bool:
    return snapshot_diff(old, new, key, order).isEmpty()


def append_changes(log: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The change log with new changes at its end, numbered by ``change_seq``.

    Changes of one step are numbered by rank. They are range-partitioned by it and
    offset by the sizes of the partitions before, so no single task sorts them all.
    They are written before they are counted: another execution could cut the
    ranges elsewhere.
    """
    spark = changes.sparkSession
    base = 0
    if log is not None:
        base = log.agg(F.coalesce(F.max("change_seq"), F.lit(-1)) + 1).first()[0]
    placed = changes.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("_part", F.spark_partition_id())
    ranked = settle(placed.withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)), "ranked")
    sizes = {r["_part"]: r["n"] for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], base
    for p in range(max(sizes, default=-1) + 1):
        starts.append((p, total))
        total += sizes.get(p, 0)
    offsets = spark.createDataFrame(starts, "_part int, _start bigint")
    numbered = ranked.join(F.broadcast(offsets), "_part").withColumn("change_seq", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start", "rank")
    return numbered if log is None else log.unionByName(numbered)


def replay(log: DataFrame, key: str = "id") -> DataFrame:
    """Latest state of every id that is not deleted: ``key``, ``event``, and ``since``, the change that started its present life.

    Ordered by ``since`` this is the snapshot's order: an edit keeps an id's place,
    an addition after a deletion moves it to the end. Without an addition after its
    last deletion an id has its first place; without any, ``since`` is null.
    """
    gone = log.where(F.col("action") == DELETE).groupBy(key).agg(F.max("change_seq").alias("_gone"))
    again = F.when(F.col("change_seq") > F.coalesce("_gone", F.lit(-1)), F.col("change_seq"))
    adds = log.where(F.col("action") == ADD).select(key, "change_seq").join(gone, key, "left").groupBy(key).agg(F.coalesce(F.min(again), F.min("change_seq")).alias("since"))
    last = log.groupBy(key).agg(F.max_by(F.struct("action", "event"), "change_seq").alias("last")).where(F.col("last.action") != DELETE)
    return last.join(adds, key, "left").select(key, "last.event", "since")


def latest_changes(log: DataFrame, key: str = "id") -> DataFrame:
    """The last change of every id."""
    newest = Window.partitionBy(key).orderBy(F.desc("change_seq"))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def store_diff(source: DataFrame, target: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """What makes ``target`` equal to ``source``: ``op`` put, delete or unchanged, for every key of either."""
    s = source.select(key, F.col(value).alias("_s"), F.lit(True).alias("_in_s"))
    t = target.select(key, F.col(value).alias("_t"), F.lit(True).alias("_in_t"))
    op = F.when(F.col("_in_s").isNull(), "delete").when(F.col("_in_t").isNull() | ~F.col("_s").eqNullSafe(F.col("_t")), "put").otherwise("unchanged")
    return s.join(t, key, "full_outer").select(key, op.alias("op"), F.col("_s").alias(value))


def apply_diff(target: DataFrame, diff: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Target after a difference; keys that it leaves alone keep their value."""
    kept = target.join(diff.where("op in ('put', 'delete')"), key, "left_anti").select(key, value)
    return kept.unionByName(diff.where("op = 'put'").select(key, value))


def diff_stats(diff: DataFrame) -> DataFrame:
    """Counts of a difference: keys of source and target, puts, deletes, unchanged."""
    is_ = lambda op: F.count_if(F.col("op") == op)
    return diff.agg(
        (F.count("*") - is_("delete")).alias("n_source"),
        is_("put").alias("n_put"),
        is_("delete").alias("n_delete"),
        is_("unchanged").alias("n_unchanged"),
    )


def content_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows on one side only, with the ``side``: the changed content of a source table."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))
