"""Driver tables as the engine's inputs, with the same adaptations in SQL.

Each adapter is a DataFrame function; ``SQL`` has the common table expression of
the same name for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.text import parsed

#: Types that count as context in the adapted log.
FIXTURE_TYPES = ("signup", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with ``seq``, ``id``, ``date``, ``input``: a type, two modifiers, a description and two tags."""
    e = table(spark, sf_dir, "events")
    k, u = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    text = F.concat(F.col("event_type"), F.lit(" [user "), u, F.lit("] [k "), k, F.lit("] note for user "), u, F.lit(" #k"), k, F.lit(" #u-"), u)
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")).alias("date"),
        F.col("ts").cast("timestamp").alias("ts"),
        text.alias("original"),
        text.alias("input"),
        F.col("user_id"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(raw_log(spark, sf_dir))


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log(spark, sf_dir).where("seq % 10 <> 0").select("seq", "id", "date", "original", "input")


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.when(F.col("seq") % 7 == 0, F.concat("input", F.lit(" edited"))).otherwise(F.col("input"))
    return raw_log(spark, sf_dir).where("seq % 10 <> 1").select("seq", "id", "date", "original", edited.alias("input"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream fragments: a user's events as a session, of one to seven times ten minutes."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(order).cast("bigint").alias("sequence"),
        start.alias("start_ms"),
        (start + (F.col("event_id") % 7 + 1) * 600_000).alias("end_ms"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"),
        (start + 1000).alias("ingested_at_ms"),
    )


def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns ``a`` and ``b``; where the turn is even, ``b`` begins with the last three words of ``a``."""
    c = table(spark, sf_dir, "conversations")
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    ahead = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.select("conv_id", "turn", ahead.alias("a"), "text").where("a is not null")
    tail = F.array_join(F.slice(words("a"), F.greatest(F.size(words("a")) - 2, F.lit(1)), 3), " ")
    return rows.select("conv_id", "turn", "a", F.when(F.col("turn") % 2 == 0, F.concat(tail, F.lit(" "), F.col("text"))).otherwise(F.col("text")).alias("b"))


_TEXT = "event_type || ' [user ' || user_id || '] [k ' || k || '] note for user ' || user_id || ' #k' || k || ' #u-' || user_id"

SQL = {
    "log": f"""log as (select event_id as seq, cast(event_id as varchar) as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' as date, ts,
 {_TEXT} as original, {_TEXT} as input, user_id, event_type as type, 'note for user ' || user_id || ' #k' || k || ' #u-' || user_id as description, k,
 ['k' || k, 'u-' || user_id] as hashtags
 from (select *, json_extract_string(props, '$.k') as k from events))""",
    "old_snapshot": "old_snapshot as (select seq, id, date, original, input from log where seq % 10 <> 0)",
    "new_snapshot": "new_snapshot as (select seq, id, date, original, case when seq % 7 = 0 then input || ' edited' else input end as input from log where seq % 10 <> 1)",
    "fragments": """fragments as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) as sequence, epoch_us(ts) // 1000 as start_ms,
 epoch_us(ts) // 1000 + (event_id % 7 + 1) * 600000 as end_ms, sha256(cast(event_id as varchar)) as content_hash, epoch_us(ts) // 1000 + 1000 as ingested_at_ms from events)""",
    "pairs": """pairs as (select conv_id, turn, a, case when turn % 2 = 0 then array_to_string(aw[greatest(len(aw) - 2, 1):], ' ') || ' ' || text else text end as b
 from (select *, list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> '') as aw from
 (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as a, text from conversations) where a is not null))""",
}


def with_sql(names: str, body: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
