"""The registered queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import keys, media
from tidelog.functions import text as tx
from tidelog.functions import time as tm
from tidelog.operators import bundle, changes, graph, intervals, log, merge
from tidelog.plans.adapters import FIXTURE_TYPES, event_log, fragments, new_snapshot, old_snapshot, raw_log, table, transcript_pairs, with_sql

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- the log ---------------------------------------------------------------------------------


@query(with_sql("log", "select seq, id, date, original, input from log"))
def src_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log(spark, sf_dir).select("seq", "id", "date", "original", "input")


@query(with_sql("log", "select id, type, description from log"))
def parse_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("id", "type", "description")


@query(with_sql("log", "select id, cast(user_id as varchar) as user_modifier, k as k_modifier, 2 as n_modifiers from log"))
def parse_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("modifiers")
    return event_log(spark, sf_dir).select("id", m["user"].alias("user_modifier"), m["k"].alias("k_modifier"), F.size(m).alias("n_modifiers"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as normal from documents")
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_ws(F.col("text")).alias("normal"))


@query(with_sql("log", "select id, array_to_string(hashtags, ' ') as tags, len(hashtags) as n_tags from log"))
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("id", F.array_join("hashtags", " ").alias("tags"), F.size("hashtags").cast("bigint").alias("n_tags"))


@query(with_sql("log", "select id, type, description from log where regexp_matches(type, 'purch', 'i') or regexp_matches(description, 'purch', 'i')"))
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.search(event_log(spark, sf_dir), "purch").select("id", "type", "description")


@query(with_sql("log", "select row_number() over (order by date desc, seq) as rank, id from log order by date desc, seq limit 500"))
def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = log.first_entries(raw_log(spark, sf_dir), 500, "desc")
    return top.selectExpr("row_number() over (order by date desc, seq) as rank", "id")


@query(with_sql("log", "select row_number() over (order by date, seq desc) as rank, id from log order by date, seq desc limit 500"))
def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = log.first_entries(raw_log(spark, sf_dir), 500, "asc")
    return top.selectExpr("row_number() over (order by date, seq desc) as rank", "id")


@query(with_sql("log", "select id, date, input from log order by date desc, seq limit 100"))
def last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.first_entries(raw_log(spark, sf_dir), 100, "desc").select("id", "date", "input")


@query(with_sql("log", "select id, date, input from log order by date, seq desc limit 100"))
def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.first_entries(raw_log(spark, sf_dir), 100, "asc").select("id", "date", "input")


@query(with_sql("log", "select id, date, type, description from log where regexp_matches(type, 'purch', 'i') or regexp_matches(description, 'purch', 'i') order by date desc, seq limit 21 offset 20"))
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.page(event_log(spark, sf_dir), page=2, limit=20, pattern="purch").select("id", "date", "type", "description")


@query(with_sql("log", "select r.id, l.input, l.id is not null as found from (select cast(user_id * 7 as varchar) as id from (select distinct user_id from events)) r left join log l on l.id = r.id"))
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select((F.col("user_id") * 7).cast("string").alias("id")).distinct()
    return log.lookup(raw_log(spark, sf_dir), requests).select("id", "input", "found")


@query("select count(*) as n from events")
def events_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.events_count(raw_log(spark, sf_dir))


@query(with_sql("log", "select id, case when type = 'diary' then description end as entry_description from (select id, description, case when seq % 3 = 0 then 'diary' else type end as type from log)"))
def entry_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_log(spark, sf_dir).withColumn("type", F.when(F.col("seq") % 3 == 0, "diary").otherwise(F.col("type")))
    return log.entry_description(own)


@query(with_sql("log", "select tag, count(*) as n from (select unnest(hashtags) as tag from log) group by tag"))
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.tag_counts(event_log(spark, sf_dir))


@query(
    with_sql(
        "log",
        """select e_id, count(*) as n from (select a.id as e_id, b.id as o_id from log a join log b on a.user_id = b.user_id where b.type in ('signup', 'purchase')
 union select a.id, b.id from log a join log b on a.k = b.k where b.type in ('signup', 'purchase') union select id, id from log) group by e_id""",
    )
)
def event_context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.context_sizes(event_log(spark, sf_dir), FIXTURE_TYPES)


@query(
    with_sql(
        "log",
        """select e_id, string_agg(o_id, ',' order by o_seq) as context from (select a.id as e_id, b.id as o_id, b.seq as o_seq from log a join log b on list_has_any(a.hashtags, b.hashtags)
 where b.type in ('signup', 'purchase') and a.seq % 50 = 0 union select id, id, seq from log where seq % 50 = 0) group by e_id""",
    )
)
def basic_context_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_log(spark, sf_dir)
    found = log.event_context(own, own.where("seq % 50 = 0"), FIXTURE_TYPES)
    return found.select("e_id", F.array_join("context", ",").alias("context"))


@query(with_sql("log", "select id as e_id, case when seq % 2 = 0 then id || ',stored' else id end as context from log"))
def context_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raw_log(spark, sf_dir)
    stored = own.where("seq % 2 = 0").select(F.col("id").alias("e_id"), F.array("id", F.lit("stored")).alias("context"))
    return log.context_or_self(own, stored).select("e_id", F.array_join("context", ",").alias("context"))


_PROPERTIES = """asked as (select id, seq, user_id from log where seq % 50 = 0),
 listed as (select e_id, string_agg(o_id || '|' || o_date, ',' order by o_seq) as basic_context from (select a.id as e_id, b.id as o_id, b.seq as o_seq, b.date as o_date from log a join log b on list_has_any(a.hashtags, b.hashtags)
 where b.type in ('signup', 'purchase') and a.seq % 50 = 0 union select id, id, seq, date from log where seq % 50 = 0) group by e_id)"""


@query(
    with_sql(
        "log",
        f""", {_PROPERTIES} select id, case when user_id % 4 = 2 then 'kcal' || id end as calories,
 case when user_id % 5 = 0 then null when user_id % 3 <> 0 then 'first' || id when user_id % 2 = 0 then 'second' || id end as transcription, basic_context,
 concat_ws(';', case when user_id % 4 = 1 then 'calories=no answer' end, case when user_id % 5 <> 0 and user_id % 3 = 0 and user_id % 2 <> 0 then 'transcription=silent' end) as errors
 from asked join listed on e_id = id union all select 'x' || id, null, null, null, '' from asked""",
    )
)
def entry_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of every fiftieth entry and of as many unknown ones, with contexts in the whole log."""
    own = event_log(spark, sf_dir)
    asked = own.where("seq % 50 = 0").select("id")
    u = F.col("user_id")
    calories = own.where(u % 4 != 3).select("id", F.when(u % 4 == 0, bundle.NOT_AVAILABLE).when(u % 4 == 2, F.concat(F.lit("kcal"), "id")).alias("value"), F.when(u % 4 == 1, "no answer").alias("error"))
    files = own.where(u % 5 != 0)
    file = lambda name, text, error: files.select("id", F.concat("id", F.lit(f"/{name}")).alias("path"), text.alias("text"), error.alias("error"))
    first = file("a.mp3", F.when(u % 3 != 0, F.concat(F.lit("first"), "id")), F.when(u % 3 == 0, "cut"))
    second = file("b.ogg", F.when(u % 2 == 0, F.concat(F.lit("second"), "id")), F.when(u % 2 != 0, "silent"))
    third = file("c.txt", F.lit("no audio"), F.lit(None).cast("string"))
    found = bundle.entry_bundle(own, asked.unionByName(asked.select(F.concat(F.lit("x"), "id").alias("id"))), calories, first.unionByName(second).unionByName(third), lambda rows: bundle.add_details(rows, own, FIXTURE_TYPES, ("date",)))
    told = F.transform("basic_context", lambda e: F.concat(e["id"], F.lit("|"), e["date"]))
    errors = F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("id", "calories", "transcription", F.array_join(told, ",").alias("basic_context"), F.array_join(errors, ";").alias("errors"))


_PROCESSED = "processed as (select id, case when seq % 3 = 0 then '2024-01-15' else date end as date from log where seq % 4 <> 0)"


@query(with_sql("log", f", {_PROCESSED} select l.id, l.date from log l left join processed p on p.id = l.id where l.type = 'view' and coalesce(p.date < l.date, true)"))
def pending_diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_log(spark, sf_dir)
    processed = own.where("seq % 4 <> 0").select("id", F.when(F.col("seq") % 3 == 0, "2024-01-15").otherwise(F.col("date")).alias("date"))
    diary = own.withColumn("type", F.when(F.col("type") == "view", log.DIARY).otherwise(F.col("type")))
    return bundle.pending_diary(diary, processed).select("id", "date")


@query(with_sql("log", "select min(date) as summary_date from (select case when seq % 2 = 0 then strftime(ts + interval 5 hour, '%Y-%m-%dT%H:%M:%S') || '+0500' else date end as date, date_trunc('second', ts) as moment from log) where moment = (select max(date_trunc('second', ts)) from log)"))
def summary_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoned = F.when(F.col("seq") % 2 == 0, tm.format_in_zone(F.col("ts"), F.lit("+0500"))).otherwise(F.col("date"))
    return bundle.summary_date(raw_log(spark, sf_dir).select("id", zoned.alias("date")), tm.instant(F.col("date")))


@query("select p_brand as name, p_type as only_for_type from part where p_type = 'none' or p_partkey % 5 = 0 or p_type in (select p_type from part where p_size > 40)")
def ontology_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    modifiers = p.select(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("only_for_type"), "p_type")
    context = p.where("p_size > 40").select(F.col("p_type").alias("type"))
    _, kept = log.ontology_filter(p.select(F.col("p_type").alias("name")), modifiers, context)
    return kept.select("name", F.col("p_type").alias("only_for_type"))


@query(with_sql("log", "select id, input from log where seq % 9 <> 0"))
def delete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raw_log(spark, sf_dir)
    return log.delete_events(own, own.where("seq % 9 = 0")).select("id", "input")


@query(with_sql("log", "select seq, id from log union all select (select max(seq) from log) + seq + 1, 'new-' || id from log where seq % 100 = 0"))
def append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = raw_log(spark, sf_dir).select("seq", "id")
    new = own.where("seq % 100 = 0").select((F.col("seq") + 1).alias("seq"), F.concat(F.lit("new-"), "id").alias("id"))
    return log.append_events(own, new)


# --- change logs and differences -----------------------------------------------------------------


@query(
    with_sql(
        "log old_snapshot new_snapshot",
        """select case when o.id is null then 'add' when n.id is null then 'delete' else 'edit' end as action, coalesce(n.id, o.id) as id, coalesce(n.input, o.input) as input
 from old_snapshot o full outer join new_snapshot n on o.id = n.id where o.id is null or n.id is null or o.input <> n.input or o.date <> n.date or o.original <> n.original""",
    )
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.snapshot_diff(old_snapshot(spark, sf_dir), new_snapshot(spark, sf_dir))
    return found.select("action", "id", F.col("event.input").alias("input"))


_CHANGES = """changes as (select event_id as change_seq, cast(user_id as varchar) as id, case when event_type = 'error' then 'delete' when event_type = 'signup' then 'add' else 'edit' end as action,
 event_type || event_id as event from events)"""


def _change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add").otherwise("edit")
    return e.select(F.col("event_id").alias("change_seq"), F.col("user_id").cast("string").alias("id"), action.alias("action"), F.concat("event_type", F.col("event_id").cast("string")).alias("event"))


@query(f"with {_CHANGES} select id, event from (select *, row_number() over (partition by id order by change_seq desc) as n from changes) where n = 1 and action <> 'delete'")
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.replay(_change_log(spark, sf_dir)).select("id", "event")


@query(f"with {_CHANGES} select change_seq, id, action, event from (select *, row_number() over (partition by id order by change_seq desc) as n from changes) where n = 1")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_changes(_change_log(spark, sf_dir)).select("change_seq", "id", "action", "event")


_STORES = """src as (select 'n/' || o_orderkey as key, o_orderstatus || case when o_orderkey % 11 = 0 then '!' else '' end as value from orders where o_orderkey % 5 <> 0),
 tgt as (select 'n/' || o_orderkey as key, o_orderstatus as value from orders where o_orderkey % 7 <> 0)"""
_OPS = "ops as (select coalesce(s.key, t.key) as key, case when s.key is null then 'delete' when t.key is null or s.value <> t.value then 'put' else 'unchanged' end as op, s.value from src s full outer join tgt t on s.key = t.key)"


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("n/"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"))
    source = o.where("o_orderkey % 5 <> 0").withColumn("value", F.concat("value", F.when(F.col("o_orderkey") % 11 == 0, "!").otherwise("")))
    return source.select("key", "value"), o.where("o_orderkey % 7 <> 0").select("key", "value")


@query(f"with {_STORES}, {_OPS} select key, op, value from ops")
def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.store_diff(*_stores(spark, sf_dir))


@query(f"with {_STORES}, {_OPS} select count(*) filter (op <> 'delete') as n_source, count(*) filter (op = 'put') as n_put, count(*) filter (op = 'delete') as n_delete, count(*) filter (op = 'unchanged') as n_unchanged from ops")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff_stats(changes.store_diff(*_stores(spark, sf_dir)))


@query(f"with {_STORES} select key, value from src")
def store_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _stores(spark, sf_dir)
    return changes.apply_diff(target, changes.store_diff(source, target))


# --- graph and replicas --------------------------------------------------------------------------

_NODES = """base as (select cast(event_id as varchar) as e, event_id, event_type from events),
 nodes as (select 'a-0' as id, 'all_events' as head, '[]' as args, '{"head":"all_events","args":[]}' as key, 'up-to-date' as freshness
 union all select 'v-' || e, 'event', '["' || e || '"]', '{"head":"event","args":["' || e || '"]}', case when event_id % 4 = 0 then 'potentially-outdated' else 'up-to-date' end from base
 union all select 'd-' || e, 'entry_description', '["' || e || '"]', '{"head":"entry_description","args":["' || e || '"]}', case when event_id % 4 = 0 then 'potentially-outdated' else 'up-to-date' end from base where event_type <> 'error')"""
_EDGES = """edges as (select id, 'a-0' as input_id, 0 as pos from nodes where head = 'event' union all select id, 'v-' || substr(id, 3), 0 from nodes where head = 'entry_description')"""
_VALID = "valid as (select input_id as dep_id, id as dependent_id from edges where cast(substr(id, 3) as bigint) % 4 <> 0)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a graph over all events; those of errors have no materialized description."""
    base = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("e"))

    def family(rows: DataFrame, prefix: str, head: str) -> DataFrame:
        args = F.to_json(F.array("e"))
        fresh = F.when(F.col("event_id") % 4 == 0, graph.STALE).otherwise(graph.FRESH)
        return rows.select(F.concat(F.lit(prefix), "e").alias("id"), F.lit(head).alias("head"), args.alias("args"), graph.node_key(F.lit(head), args).alias("key"), fresh.alias("freshness"))

    root = spark.range(1).select(F.lit("a-0").alias("id"), F.lit("all_events").alias("head"), F.lit("[]").alias("args"), graph.node_key(F.lit("all_events"), F.lit("[]")).alias("key"), F.lit(graph.FRESH).alias("freshness"))
    return root.unionByName(family(base, "v-", "event")).unionByName(family(base.where("event_type <> 'error'"), "d-", "entry_description"))


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and proofs of that graph."""
    nodes = _nodes(spark, sf_dir)
    edges = graph.derive_edges(nodes, graph.scheme_table(spark, graph.default_families())).select("id", "input_id", "pos")
    valid = edges.where("cast(substr(id, 3) as bigint) % 4 <> 0").select(F.col("input_id").alias("dep_id"), F.col("id").alias("dependent_id"))
    return nodes, edges, valid


_DEPTH = 3


@query(f"with {_NODES}, {_EDGES} select id, input_id, pos from edges")
def edge_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)[1]


@query(f"with {_NODES}, {_EDGES}, {_VALID} select n.id, count(e.id) > 0 and count(e.id) = count(v.dep_id) as usable from nodes n left join edges e on e.id = n.id left join valid v on v.dependent_id = e.id and v.dep_id = e.input_id group by n.id")
def cache_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cache_usable(*_state(spark, sf_dir))


@query(
    f"""with recursive {_NODES}, {_EDGES}, {_VALID}, reached as (select id from nodes where head = 'event' and cast(substr(id, 3) as bigint) % 6 = 1
 union select v.dependent_id from reached r join valid v on v.dep_id = r.id)
 select n.id, case when r.id is not null then 'potentially-outdated' else n.freshness end as freshness from nodes n left join reached r on r.id = n.id"""
)
def invalidate_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, valid = _state(spark, sf_dir)
    targets = nodes.where("head = 'event' and cast(substr(id, 3) as bigint) % 6 = 1").select("id")
    return graph.invalidate(nodes, valid, targets, _DEPTH)[0].select("id", "freshness")


@query(f"with {_NODES} select id, case head when 'all_events' then 0 when 'event' then 1 else 2 end as level from nodes")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _state(spark, sf_dir)
    return graph.topological_levels(edges, nodes, _DEPTH)


@query(
    f"""with {_NODES}, {_EDGES}, {_VALID} select 'fresh on stale input' as rule, e.id from edges e join nodes n on n.id = e.id join nodes i on i.id = e.input_id
 where n.freshness = 'up-to-date' and i.freshness <> 'up-to-date'
 union all select 'fresh without proof', e.id from edges e join nodes n on n.id = e.id where n.freshness = 'up-to-date' and not exists (select 1 from valid v where v.dependent_id = e.id and v.dep_id = e.input_id)
 union all select 'times', id from nodes where cast(substr(id, 3) as bigint) % 50 = 7"""
)
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, valid = _state(spark, sf_dir)
    odd = F.expr("cast(substr(id, 3) as bigint) % 50 = 7")
    timed = nodes.withColumns({"created_at": F.when(odd, "2024-01-02").otherwise("2024-01-01"), "modified_at": F.lit("2024-01-01")})
    return graph.violations(timed, valid, edges)


@query(
    f"""with {_NODES}, wanted as (select h as head, '["' || event_id || '"]' as args from events, (select unnest(['event', 'entry_description']) as h) union all select 'all_events', '[]')
 select w.head, w.args, n.id, n.freshness from wanted w left join nodes n on n.head = w.head and n.args = w.args"""
)
def inspect_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("event"), F.lit("entry_description"))).alias("head"), F.to_json(F.array(F.col("event_id").cast("string"))).alias("args"))
    wanted = own.unionByName(spark.range(1).select(F.lit("all_events").alias("head"), F.lit("[]").alias("args")))
    return graph.inspect(graph.default_families(), wanted, _nodes(spark, sf_dir)).select("head", "args", "id", "freshness")


_VALUES = """vals as (select event_id, event_id % 7 as kind, event_id // 7 % 5 as a, event_id // 35 % 3 as b from events),
 pairs as (select x.event_id, x.kind as xk, x.a as xa, x.b as xb, y.kind as yk, y.a as ya, y.b as yb from vals x join vals y on y.event_id = x.event_id // 2),
 ranked as (select *, [0, 1, 2, 3, 4, 4, 5][xk + 1] as xr, [0, 1, 2, 3, 4, 4, 5][yk + 1] as yr from pairs),
 keyed as (select *, case xk when 0 then [0] when 1 then [xa % 2] when 2 then [xa - 2] when 3 then [xa] when 4 then [xa, xb] when 5 then [xa] else [xa % 2, xb] end as xv,
 case yk when 0 then [0] when 1 then [ya % 2] when 2 then [ya - 2] when 3 then [ya] when 4 then [ya, yb] when 5 then [ya] else [ya % 2, yb] end as yv from ranked)"""


@query(f"with {_VALUES} select event_id, case when xr < yr or xr = yr and xv < yv then -1 when xr = yr and xv = yv then 0 else 1 end as sign from keyed")
def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of each event's node against another's, with arguments of all types."""
    e = table(spark, sf_dir, "events").select("event_id")
    kind, a, b = F.expr("event_id % 7"), F.expr("event_id div 7 % 5"), F.expr("event_id div 35 % 3")
    told = (
        F.when(kind == 0, "null").when(kind == 1, F.when(a % 2 == 1, "true").otherwise("false")).when(kind == 2, F.format_string("%d.5", a - 2))
        .when(kind == 3, F.format_string('"t%d"', a)).when(kind == 4, F.format_string("[%d, %d]", a, b)).when(kind == 5, F.format_string("[%d]", a))
        .otherwise(F.format_string('{"z": %d, "k%d": null}', b, a % 2))
    )
    own = e.select("event_id", keys.node_order(F.lit("node"), F.format_string("[%s]", told)).alias("key"))
    met = own.withColumn("other", F.expr("event_id div 2"))
    sign = F.when(F.col("key") < F.col("_key"), -1).when(F.col("key") == F.col("_key"), 0).otherwise(1)
    return met.join(own.select(F.col("event_id").alias("other"), F.col("key").alias("_key")), "other").select("event_id", sign.alias("sign"))


_REPLICAS = """keyed as (select event_id, 'event/' || event_id as key, ts from events union all select event_id, 'pair/' || event_id, ts from events where event_id % 4 = 0),
 t as (select key, 't' || key as id, case when event_id % 5 = 0 then 'potentially-outdated' else 'up-to-date' end as freshness, epoch_us(ts) // 1000 as m, 'aaaaaaaaa' as fp from keyed where event_id % 3 <> 0),
 h as (select key, case when event_id % 2 = 0 then 't' else 'h' end || key as id, 'up-to-date' as freshness, epoch_us(ts) // 1000 + (event_id % 5 - 2) * 60000 as m, 'bbbbbbbbb' as fp from keyed where event_id % 3 <> 1),
 kedges as (select key, 'event/' || event_id as input_key from keyed where key like 'pair/%' union all select key, 'event/' || (event_id + 4) from keyed where key like 'pair/%' and event_id % 8 = 0),
 chosen as (select coalesce(t.key, h.key) as key, case when h.key is null then 'T' when t.key is null then 'H' when (t.m, t.id, t.fp) >= (h.m, h.id, h.fp) then 'T' else 'H' end as side,
 t.key is not null and h.key is not null and (t.m, t.id, t.fp) <> (h.m, h.id, h.fp) as root, t.id as t_id, h.id as h_id, t.freshness as tf, h.freshness as hf, t.m as tm, h.m as hm from t full outer join h on t.key = h.key)"""
_TAINT = """, taints(key, taint) as (select key, side from chosen where root union select e.key, s.taint from taints s join kedges e on e.input_key = s.key)"""
_BAD = """, bad as (select s.key from taints s join chosen c on c.key = s.key where s.taint <> c.side
 union select e.key from kedges e join chosen c on c.key = e.key join chosen i on i.key = e.input_key
 where c.side <> i.side or (case when c.side = 'T' then i.t_id else i.h_id end) is distinct from (case when i.side = 'T' then i.t_id else i.h_id end)
 union select key from chosen where tm = hm and t_id = h_id and (case when side = 'T' then tf else hf end) = 'up-to-date' and (tf <> 'up-to-date' or hf <> 'up-to-date'))
 , gone(key) as (select key from bad where key in (select key from kedges group by key having count(distinct input_key) > 1) union select e.key from gone g join kedges e on e.input_key = g.key)
 , outcomes as (select key, side, case when key in (select key from gone) then 'delete' when key in (select key from bad) then 'invalidate' when side = 'T' then 'keep' else 'take' end as outcome from chosen)"""


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("e"))
    keyed = e.withColumn("key", F.concat(F.lit("event/"), "e")).unionByName(e.where("event_id % 4 = 0").withColumn("key", F.concat(F.lit("pair/"), "e")))
    stamp = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stale = F.when(F.col("event_id") % 5 == 0, graph.STALE).otherwise(graph.FRESH)
    t = keyed.where("event_id % 3 <> 0").select("key", F.concat(F.lit("t"), "key").alias("id"), stale.alias("freshness"), stamp("ts").alias("created_at"), stamp("ts").alias("modified_at"), F.lit("aaaaaaaaa").alias("fingerprint"))
    later = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 5 - 2).cast("int"))
    own = F.concat(F.when(F.col("event_id") % 2 == 0, "t").otherwise("h"), "key")
    h = keyed.where("event_id % 3 <> 1").select("key", own.alias("id"), F.lit(graph.FRESH).alias("freshness"), stamp("ts").alias("created_at"), stamp(later).alias("modified_at"), F.lit("bbbbbbbbb").alias("fingerprint"))
    pairs = keyed.where("key like 'pair/%'")
    edges = pairs.select("key", F.concat(F.lit("event/"), "e").alias("input_key")).unionByName(pairs.where("event_id % 8 = 0").select("key", F.concat(F.lit("event/"), (F.col("event_id") + 4).cast("string")).alias("input_key")))
    return t, h, edges


@query(f"with {_REPLICAS} select key, side, root from chosen")
def lww_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h, _ = _replicas(spark, sf_dir)
    return merge.select_candidates(t, h).select("key", "side", "root")


@query(f"with recursive {_REPLICAS} {_TAINT} select key, taint from taints")
def taint_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h, edges = _replicas(spark, sf_dir)
    return merge.taint(merge.select_candidates(t, h), edges, _DEPTH)


@query(f"with recursive {_REPLICAS} {_TAINT} {_BAD} select key from gone")
def merge_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h, edges = _replicas(spark, sf_dir)
    return merge.deletion_closure(merge.invalidation_candidates(merge.select_candidates(t, h), edges, _DEPTH), edges, _DEPTH)


@query(f"with recursive {_REPLICAS} {_TAINT} {_BAD} select key, side, outcome from outcomes")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_outcomes(*_replicas(spark, sf_dir), _DEPTH).select("key", "side", "outcome")


@query(f"with recursive {_REPLICAS} {_TAINT} {_BAD} select outcome, count(*) as n from outcomes group by outcome")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.outcome_counts(merge.merge_outcomes(*_replicas(spark, sf_dir), _DEPTH))


@query(
    f"""with recursive {_REPLICAS} {_TAINT} {_BAD} select distinct e.input_key as dep_key, e.key from kedges e join outcomes o on o.key = e.key join outcomes i on i.key = e.input_key
 where o.side = i.side and o.outcome not in ('delete', 'invalidate') and i.outcome <> 'delete'"""
)
def proof_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h, edges = _replicas(spark, sf_dir)
    proofs = edges.select(F.col("input_key").alias("dep_key"), "key")
    return merge.transport_proofs(merge.merge_outcomes(t, h, edges, _DEPTH), edges, proofs, proofs)


@query(
    f"""with recursive {_REPLICAS} {_TAINT} {_BAD}, final as (select c.key, case when c.side = 'T' then t_id else h_id end as id, case when o.outcome = 'invalidate' then 'potentially-outdated' when c.side = 'T' then tf else hf end as f
 from chosen c join outcomes o on o.key = c.key where o.outcome <> 'delete'),
 st(key) as (select key from final where f <> 'up-to-date' union select e.key from st s join kedges e on e.input_key = s.key)
 select key, id, case when key in (select key from st) then 'potentially-outdated' else f end as freshness from final"""
)
def merge_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, h, edges = _replicas(spark, sf_dir)
    proofs = edges.select(F.col("input_key").alias("dep_key"), "key")
    own, other = (merge.Replica(n, edges, proofs, "1", "s", f) for n, f in ((t, "aaaaaaaaa"), (h, "bbbbbbbbb")))
    return merge.merge_replicas(own, other, _DEPTH)[0].nodes.select("key", "id", "freshness")


_DECIDED = """old as (select 'o/' || o_orderkey as key, o_orderkey as k from orders), decided as (select key, case when k % 6 = 0 then 'delete' when k % 5 = 0 then 'invalidate' else 'keep' end as decision from old where k % 97 <> 0),
 medges as (select key, 'o/' || (k // 2) as input_key, k from old where k % 2 = 0)"""


def _migration(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    old = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderkey").alias("k"))
    decision = F.when(F.col("k") % 6 == 0, "delete").when(F.col("k") % 5 == 0, "invalidate").otherwise("keep")
    edges = old.where("k % 2 = 0").select("key", F.concat(F.lit("o/"), F.expr("cast(k div 2 as string)")).alias("input_key"), "k")
    return old, old.where("k % 97 <> 0").select("key", decision.alias("decision")), edges


@query(f"with {_DECIDED} select key from old where key not in (select key from decided)")
def migration_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, decided, _ = _migration(spark, sf_dir)
    return merge.undecided(decided, old)


@query(f"with recursive {_DECIDED}, gone(key) as (select key from old where k % 6 = 3 union select e.key from gone g join medges e on e.input_key = g.key) select key as id from gone")
def migration_delete_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, edges = _migration(spark, sf_dir)
    start = old.where("k % 6 = 3").select(F.col("key").alias("id"))
    return graph.closure(start, edges.select(F.col("input_key").alias("from_id"), F.col("key").alias("to_id")))


@query(f"with {_DECIDED} select e.input_key as dep_key, e.key from medges e join decided d on d.key = e.key join decided i on i.key = e.input_key where d.decision = 'keep' and i.decision <> 'delete' and e.k % 3 <> 0")
def desired_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, decided, edges = _migration(spark, sf_dir)
    proofs = edges.select(F.col("input_key").alias("dep_key"), "key")
    return merge.desired_valid(decided, proofs, edges, edges.where("k % 3 <> 0"))


# --- schedules ------------------------------------------------------------------------------------

_TASKS = """tasks as (select 'task-' || o_orderkey as name, (o_orderkey % 60) as mi, (o_orderkey % 24) as ho, case when o_orderkey % 3 = 0 then o_orderkey % 28 + 1 end as dom, case when o_orderkey % 4 = 0 then o_orderkey % 7 end as dow,
 o_orderdate + to_minutes(cast(o_orderkey % 1440 as bigint)) as origin, o_orderkey as k from orders)"""
_DAYS = """days as (select t.*, d.day from tasks t, (select unnest(range(-400, 401)) as off) x, lateral (select cast(cast(t.origin as date) + cast(x.off as int) as date) as day) d
 where case when dom is not null and dow is not null then day(d.day) = dom or dayofweek(d.day) = dow else (dom is null or day(d.day) = dom) and (dow is null or dayofweek(d.day) = dow) end),
 runs as (select *, day + to_hours(cast(ho as bigint)) + to_minutes(cast(mi as bigint)) as run_at from days)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with cron expressions, and an instant each."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    part = lambda x: x.cast("string")
    cron = F.concat_ws(" ", part(k % 60), part(k % 24), F.when(k % 3 == 0, part(k % 28 + 1)).otherwise("*"), F.lit("*"), F.when(k % 4 == 0, part(k % 7)).otherwise("*"))
    origin = F.timestamp_add("MINUTE", (k % 1440).cast("int"), F.col("o_orderdate").cast("timestamp"))
    return o.select(F.concat(F.lit("task-"), part(k)).alias("name"), cron.alias("cron"), origin.alias("origin"), k.alias("k"))


def _scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).withColumns(tm.cron_columns(F.col("cron")))


@query(f"with {_TASKS} select name, hour(origin) = ho and minute(origin) = mi and case when dom is not null and dow is not null then day(origin) = dom or dayofweek(origin) = dow else (dom is null or day(origin) = dom) and (dow is null or dayofweek(origin) = dow) end as matches from tasks")
def cron_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scheduled(spark, sf_dir).select("name", tm.cron_matches(F.col("origin")).alias("matches"))


@query(f"with {_TASKS}, {_DAYS} select name, strftime(max(run_at), '%Y-%m-%d %H:%M') as previous from runs where run_at <= origin group by name")
def cron_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scheduled(spark, sf_dir).select("name", F.date_format(tm.cron_previous(F.col("origin")), "yyyy-MM-dd HH:mm").alias("previous"))


@query(f"with {_TASKS}, {_DAYS} select name, strftime(min(run_at), '%Y-%m-%d %H:%M') as following from runs where run_at > origin group by name")
def cron_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scheduled(spark, sf_dir).select("name", F.date_format(tm.cron_next(F.col("origin")), "yyyy-MM-dd HH:mm").alias("following"))


_STATES = "states as (select name, origin, k, max(run_at) filter (run_at <= origin) as previous from runs group by name, origin, k)"


def _task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tasks(spark, sf_dir)
    last = F.when(F.col("k") % 3 != 1, F.timestamp_add("HOUR", -(F.col("k") % 500).cast("int"), F.col("origin")))
    retry = F.when(F.col("k") % 7 == 0, F.timestamp_add("MINUTE", (F.col("k") % 11 - 5).cast("int"), F.col("origin")))
    return t.withColumns({"last_attempt": last, "pending_retry_until": retry, "running": F.col("k") % 13 == 0})


@query(
    f"""with {_TASKS}, {_DAYS}, {_STATES} select name, case when k % 13 = 0 then 'running' when k % 7 = 0 and k % 11 - 5 <= 0 then 'retry'
 when k % 3 = 1 or origin - to_hours(cast(k % 500 as bigint)) < previous then 'cron' when k % 7 = 0 then 'waiting_retry' else 'waiting' end as decision from states"""
)
def due_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.evaluate_tasks(_task_states(spark, sf_dir), F.col("origin")).select("name", "decision")


_NOW = "1991-06-01 08:00:00"


@query(
    f"""with {_TASKS}, calendar as (select cast(date '1991-06-01' + cast(off as int) as date) as day from (select unnest(range(0, 40)) as off)),
 runs as (select d.day + to_hours(cast(ho as bigint)) + to_minutes(cast(mi as bigint)) as run_at from tasks, calendar d
 where case when dom is not null and dow is not null then day(d.day) = dom or dayofweek(d.day) = dow else (dom is null or day(d.day) = dom) and (dow is null or dayofweek(d.day) = dow) end),
 due as (select min(run_at) as due from (select run_at from runs where run_at > timestamp '{_NOW}' union all select origin + to_minutes(cast(k % 11 - 5 as bigint)) from tasks where k % 7 = 0))
 select strftime(due, '%Y-%m-%d %H:%M') as due, greatest(1000, least(10800000, epoch_ms(due) - epoch_ms(timestamp '{_NOW}'))) as sleep_ms from due"""
)
def next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tm.next_due(_task_states(spark, sf_dir), F.lit(_NOW).cast("timestamp"))
    return found.select(F.date_format("due", "yyyy-MM-dd HH:mm").alias("due"), "sleep_ms")


# --- fragments ------------------------------------------------------------------------------------

_WATERMARK, _DEADLINE = "1704150000000", "1706000000000"
_COVER = f"""inside as (select * from fragments where end_ms > {_WATERMARK} and start_ms < {_DEADLINE}),
 covered as (select *, greatest(coalesce(max(end_ms) over (partition by session_id order by start_ms, sequence rows between unbounded preceding and 1 preceding), {_WATERMARK}), {_WATERMARK}) as covered from inside)"""


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.candidates(fragments(spark, sf_dir), F.lit(int(_WATERMARK)), F.lit(int(_DEADLINE)))


@query(with_sql("fragments", "select session_id, sequence, start_ms, end_ms, content_hash from fragments"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir).select("session_id", "sequence", "start_ms", "end_ms", "content_hash")


@query(with_sql("fragments", f", {_COVER} select session_id, covered as start_ms, start_ms as end_ms from covered where start_ms > covered"))
def gap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.find_gaps(_inside(spark, sf_dir), F.lit(int(_WATERMARK)))


@query(
    with_sql(
        "fragments",
        f""", {_COVER}, waiting as (select session_id, min(covered) as stop from covered where start_ms > covered and session_id % 2 = 1 group by session_id),
 crossed as (select session_id, min(covered) as crossed from covered where start_ms > covered and session_id % 2 = 0 group by session_id)
 select s.session_id, least({_DEADLINE}, coalesce(w.stop, greatest(c.e, {_WATERMARK}), {_WATERMARK})) as processable_end, coalesce(w.stop = {_WATERMARK}, false) as blocked, x.crossed is not null as degraded
 from (select distinct session_id from fragments) s left join (select session_id, max(end_ms) as e from inside group by session_id) c on c.session_id = s.session_id
 left join waiting w on w.session_id = s.session_id left join crossed x on x.session_id = s.session_id""",
    )
)
def processable_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fragments(spark, sf_dir)
    sessions = own.select("session_id").distinct().select("session_id", F.lit(int(_WATERMARK)).alias("watermark_ms"), F.lit(int(_DEADLINE)).alias("deadline_ms"), F.lit(int(_DEADLINE)).alias("now_ms"))
    # gaps of even sessions are known, and old enough to be given up
    gaps = intervals.find_gaps(_inside(spark, sf_dir), F.lit(int(_WATERMARK))).where("session_id % 2 = 0")
    known = gaps.select("session_id", "start_ms", "end_ms", F.lit(0).cast("bigint").alias("first_observed_ms"), F.lit("waiting").alias("status"))
    return intervals.scan_gaps(own, sessions, known)[0]


@query(with_sql("fragments", f", {_COVER} select session_id, sequence, greatest(start_ms, covered) as from_ms, least(end_ms, {_DEADLINE}) as to_ms from covered where least(end_ms, {_DEADLINE}) > greatest(start_ms, covered)"))
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clip_segments(_inside(spark, sf_dir), F.lit(int(_WATERMARK)), F.lit(int(_DEADLINE)))


@query(
    with_sql(
        "fragments",
        f""", {_COVER}, seg as (select session_id, greatest(start_ms, covered) as f, least(end_ms, {_DEADLINE}) as t from covered where least(end_ms, {_DEADLINE}) > greatest(start_ms, covered))
 select session_id, p as from_ms, f as to_ms from (select *, coalesce(lag(t) over (partition by session_id order by f), {_WATERMARK}) as p from seg) where f > p
 union all select session_id, max(t), {_DEADLINE} from seg group by session_id having max(t) < {_DEADLINE}""",
    )
)
def silence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.silence_segments(_inside(spark, sf_dir), F.lit(int(_WATERMARK)), F.lit(int(_DEADLINE)))


@query(
    with_sql(
        "fragments",
        """select session_id, sequence, greatest(0, start_ms - o) as window_start, least(end_ms, greatest(0, start_ms - o) + 1200000) as window_end, o as overlap_ms
 from (select *, greatest(10000, least(greatest(sequence * 5000, 0), 60000)) as o from fragments)""",
    )
)
def overlap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = intervals.plan_window(F.col("start_ms"), F.col("end_ms"), F.col("sequence") * 5000)
    return fragments(spark, sf_dir).select("session_id", "sequence", w.alias("w")).select("session_id", "sequence", F.col("w.start_ms").alias("window_start"), F.col("w.end_ms").alias("window_end"), F.col("w.overlap_ms").alias("overlap_ms"))


@query(
    with_sql(
        "fragments",
        """select session_id, sequence, case when sequence % 3 = 0 then 'new' when sequence % 5 <> 0 then 'duplicate_no_op' when start_ms < 1705000000000 then 'duplicate_rejected' else 'replaced' end as status,
 case when sequence % 3 = 0 then ingested_at_ms + 1 else ingested_at_ms end as ingested_at_ms from fragments""",
    )
)
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fragments(spark, sf_dir)
    sent = own.withColumns({"content_hash": F.when(F.col("sequence") % 5 == 0, F.lit("other")).otherwise(F.col("content_hash")), "ingested_at_ms": F.col("ingested_at_ms") + 1})
    marks = own.select("session_id").distinct().withColumn("watermark_ms", F.lit(1_705_000_000_000))
    return intervals.ingest(own.where("sequence % 3 <> 0"), sent, marks)


@query(with_sql("fragments", "select session_id, count(*) as n_fragments, max(sequence) as last_sequence, arg_max(end_ms, sequence) as last_end_ms, cast(ceil(arg_max(end_ms, sequence) / 1000.0) as bigint) as elapsed_seconds from fragments group by session_id"))
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.session_rollup(fragments(spark, sf_dir))


@query(with_sql("fragments", "select session_id, arg_min(start_ms, sequence) as first_start_ms, arg_max(end_ms, sequence) as last_end_ms, count(*) as n from fragments group by session_id"))
def last_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.last_range(fragments(spark, sf_dir))


# --- texts and files -------------------------------------------------------------------------------


@query("select conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n_words, case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 10 then 0 when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 30 then 1 when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 60 then 2 else 5 end as budget from conversations")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tx.word_count(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.cast("bigint").alias("n_words"), tx.question_budget(n).alias("budget"))


_NORM = "regexp_replace(regexp_replace(lower(w), '[^a-z0-9''-]', '', 'g'), '^[-'']+|[-'']+$', '', 'g')"
_KEPT = "list_filter(list_transform(regexp_split_to_array({}, '\\s+'), lambda w: " + _NORM + "), lambda w: w <> '')"
_OVERLAP = rf""", worded as (select *, list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> '') as aw, list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> '') as bw from pairs),
 normed as (select *, list_transform(aw, lambda w: {_NORM}) as an, list_transform(bw, lambda w: {_NORM}) as bn from worded),
 fitted as (select *, coalesce(list_max(list_filter(range(1, least(len(an), len(bn)) + 1), lambda k: an[len(an) - k + 1:] = bn[1:k] and not list_contains(bn[1:k], ''))), 0) as k from normed)"""


@query(
    with_sql(
        "pairs",
        _OVERLAP + " select conv_id, turn, cast(k as int) as overlap, case when len(aw) = 0 then b when len(bw) = 0 then a when k > 0 then array_to_string(list_concat(aw, bw[k + 1:]), ' ') else a || ' [10-second overlap] ' || b end as merged from fitted",
    )
)
def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = transcript_pairs(spark, sf_dir).withColumn("found", tx.overlap(F.col("a"), F.col("b")))
    return pairs.select("conv_id", "turn", F.col("found.length").alias("overlap"), "found.merged")


@query(
    with_sql(
        "pairs",
        rf""", told as (select *, case turn % 3 when 0 then a || ' ' || b when 1 then b || ' ' || a else a || ' between ' || b end as r from pairs),
 plain as (select conv_id, turn, {_KEPT.format("a")} as x, {_KEPT.format("b")} as y, {_KEPT.format("r")} as z from told)
 select conv_id, turn, len(list_filter(range(0, len(z) + 1), lambda i: z[1:i] = x[1:i] and len(z) - i <= len(y) and z[i + 1:] = y[len(y) - len(z) + i + 1:])) > 0 as valid from plain""",
    )
)
def combination_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both transcripts as they are, the wrong way round, or with a word between."""
    told = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", "a", "b")).when(F.col("turn") % 3 == 1, F.concat_ws(" ", "b", "a")).otherwise(F.concat_ws(" between ", "a", "b"))
    return transcript_pairs(spark, sf_dir).select("conv_id", "turn", tx.combination_valid(told, F.col("a"), F.col("b")).alias("valid"))


@query(with_sql("log", "select id, substr(date, 1, 7) || '/' || substr(date, 9, 2) || '/' || id as directory from log"))
def asset_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log(spark, sf_dir).select("id", tm.asset_directory(F.col("date"), F.col("id")).alias("directory"))


_ENDS = (".PNG", ".mp3", ".webm", ".txt", ".jpeg", "", ".HEIC", ".weba", "/Diary-Audio.webm", ".svg", "/.png", ".opus")
_FILES = f"files as (select doc_id, 'f' || doc_id || ({list(_ENDS)!r})[doc_id % 12 + 1] as name from documents)"


@query(f"with {_FILES} select name, case when doc_id % 12 in (0, 4, 6) then 'image' when doc_id % 12 in (1, 7, 8, 11) then 'audio' else 'other' end as media from files")
def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("doc_id") % 12 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ends).alias("name"))
    return files.select("name", media.media_type(F.col("name")).alias("media"))


@query("select event_id, case when event_id % 10 <> 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as at from events")
def file_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    name = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("20241399T"), F.substring(stamp, 10, 6), F.lit("Z.webm"))).otherwise(F.concat(stamp, F.lit("Z.webm")))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(tm.file_timestamp(name), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """with recursive digits(o_orderkey, n, s) as (select o_orderkey, o_orderkey, '' from orders
 union all select o_orderkey, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(n % 36 as bigint) + 1, 1) || s from digits where n > 0)
 select o_orderkey, case when s = '' then '0' else s end || '-abcdefghi' as node_id from digits where n = 0"""
)
def node_id_base36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.node_id(F.col("o_orderkey"), F.lit("abcdefghi")).alias("node_id"))


@query(
    """with parts as (select page_id, unnest(string_split(url, '/')) as segment from pages)
 select page_id, segment, case segment when '' then '%00' when '.' then '%2E' when '..' then '%2E%2E' else replace(replace(replace(segment, '%', '%25'), '/', '%2F'), '!', '%21') end as encoded, segment as decoded from parts"""
)
def encode_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "/", -1)).alias("segment"))
    return parts.withColumn("encoded", tx.encode_segment(F.col("segment"))).withColumn("decoded", tx.decode_segment(F.col("encoded")))


@query("""select event_id, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' when 1 then strftime(ts + interval 330 minute, '%Y-%m-%dT%H:%M:%S.%g') || '+05:30' else strftime(ts - interval 7 hour, '%Y-%m-%dT%H:%M:%S.%g') || '-07:00' end as iso from events""")
def iso_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("event_id") % 3 == 0, "UTC").when(F.col("event_id") % 3 == 1, "+05:30").otherwise("UTC-7")
    return table(spark, sf_dir, "events").select("event_id", tm.iso_in_zone(F.col("ts").cast("timestamp"), zone).alias("iso"))


@query(
    """with parts as (select event_id, ['', '+', '-'][event_id % 3 + 1] as sign, event_id // 3 % 20 as h, event_id // 60 % 70 as m, event_id % 10 as kind from events)
 select event_id, case when kind = 0 then 'Europe/Berlin' when kind = 1 then null when h > 14 then null when kind < 5 then 'UTC' || replace(sign, '+', '') || case when sign = '-' then '' else '+' end || h
 when m > 59 then null when m = 0 then 'UTC' || case when sign = '-' then '-' else '+' end || h else 'UTC' || case when sign = '-' then '-' else '+' end || lpad(cast(h as varchar), 2, '0') || ':' || lpad(cast(m as varchar), 2, '0') end as zone from parts"""
)
def client_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    sign, h, m = F.element_at(F.array(F.lit(""), F.lit("+"), F.lit("-")), (e % 3 + 1).cast("int")), F.expr("event_id div 3 % 20"), F.expr("event_id div 60 % 70")
    text = F.when(e % 10 == 0, "Europe/Berlin").when(e % 10 == 1, "Nowhere/City").when(e % 10 < 5, F.concat(sign, h.cast("string"))).otherwise(F.concat(sign, h.cast("string"), F.format_string(":%02d", m)))
    return table(spark, sf_dir, "events").select("event_id", tm.client_zone(text).alias("zone"))


@query("""select event_id, case when event_id % 2 = 0 then '"' || user_id || '",' || event_id || ',"~' || event_type || '","a/b+c d"' else '"' || event_type || '",{"k":' || user_id || '},null' end as args from events""")
def url_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.col("user_id").cast("string"), F.lit("/~"), F.col("event_id").cast("string"), F.lit("//~~"), "event_type", F.lit("/a%2Fb+c%20d/"))
    other = F.concat("event_type", F.lit('/~%7B"k":'), F.col("user_id").cast("string"), F.lit("%7D/~null/~%22%22"))
    path = F.when(F.col("event_id") % 2 == 0, whole).otherwise(other)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(keys.url_arguments(path), ",").alias("args"))


# --- files of entries, and streams' helpers -----------------------------------------------------------

_MEDIA = """, files as (select id, seq, substr(date, 1, 7) || '/' || substr(date, 9, 2) || '/' || id || '/' || name as path, name,
 case when seq % 3 = 0 then ' ' else 'said ' || name end as text from (select *, unnest(case when seq % 8 = 0 then ['voice.mp3', 'another.wav'] when seq % 4 = 0 then ['voice.mp3']
 when seq % 4 = 1 then ['photo.png'] when seq % 4 = 2 then ['Diary-Audio.webm'] else [] end) as name from log)), audio as (select * from files where name <> 'photo.png')
"""


def _entry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of entries, two, one or none, with transcriptions, some of them blank."""
    named = lambda *names: F.array(*[F.lit(n) for n in names])
    seq = F.col("seq")
    names = F.when(seq % 8 == 0, named("voice.mp3", "another.wav")).when(seq % 4 == 0, named("voice.mp3")).when(seq % 4 == 1, named("photo.png")).when(seq % 4 == 2, named("Diary-Audio.webm"))
    own = raw_log(spark, sf_dir).select("id", "seq", "date", F.explode(names).alias("name"))
    path = F.concat(tm.asset_directory(F.col("date"), F.col("id")), F.lit("/"), "name")
    return own.select("id", "seq", path.alias("path"), "name", F.when(seq % 3 == 0, " ").otherwise(F.concat(F.lit("said "), "name")).alias("text"))


@query(with_sql("log", f"{_MEDIA} select log.id, coalesce(string_agg(path, ',' order by path), '') as paths from log left join audio on log.id = audio.id group by log.id"))
def audio_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_lists(raw_log(spark, sf_dir), _entry_files(spark, sf_dir)).select("id", F.array_join("paths", ",").alias("paths"))


@query(with_sql("log", f"{_MEDIA} select log.id, description || coalesce(string_agg(chr(10) || text, '' order by path) filter (where text <> ' '), '') as content from log left join audio on log.id = audio.id group by log.id, description"))
def diary_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, files = event_log(spark, sf_dir), _entry_files(spark, sf_dir)
    return media.diary_content(own.select("id", F.col("description").alias("entry_description")), media.audio_lists(own, files), files)


@query(with_sql("log", f"{_MEDIA} select log.id, count(path) = 0 or bool_or(log.seq % 5 <> 0) as is_transcribed from log left join audio on log.id = audio.id group by log.id"))
def is_transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _entry_files(spark, sf_dir)
    return media.transcribed(media.audio_lists(raw_log(spark, sf_dir), files), files.where("seq % 5 <> 0"))


@query(
    with_sql(
        "log",
        f"""{_MEDIA} select case when seq % 7 = 1 then 'x' else '' end || id as id, text, case when seq % 7 = 0 then 'not the event''s file' when seq % 7 = 1 then 'no such event' end as error from files""",
    )
)
def event_transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh path is in another month, the next in the directory of an unknown entry."""
    files = _entry_files(spark, sf_dir)
    path = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("1999-01/01/"), "id", F.lit("/"), "name")).when(F.col("seq") % 7 == 1, F.concat(F.lit("2024-01/01/x"), "id", F.lit("/"), "name")).otherwise(F.col("path"))
    return media.event_transcriptions(raw_log(spark, sf_dir), files.select(path.alias("path"), "text")).select("id", "text", "error")


@query("select user_id as session_id, string_agg(lpad(printf('%X', event_id % 65536), 4, '0'), '' order by event_id) as pcm, 8000 as sample_rate, 1 as channels, 16 as bit_depth, 44 + 2 * count(*) as n_bytes from events group by user_id")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks of one sample, assembled into a file and parsed again."""
    sample = F.unhex(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"))
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("sequence"), sample.alias("pcm"))
    told = media.assemble_wav(chunks, 8000).withColumn("w", media.parse_wav(F.col("wav")))
    return told.select("session_id", F.hex("w.pcm").alias("pcm"), "w.sample_rate", "w.channels", "w.bit_depth", F.length("wav").alias("n_bytes"))


@query(
    """select event_id, case event_id % 9 when 0 then 'sequence' when 1 then 'start_ms' when 2 then 'end_ms' when 3 then 'pcm' when 4 then 'sample_rate' when 5 then 'channels'
 when 6 then 'bit_depth' when 7 then 'frames' end as fault from events"""
)
def chunk_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 9)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    k = lambda n, bad, good: F.when(F.col("k") == n, bad).otherwise(good)
    pcm = F.when(F.col("k") == 7, F.unhex(F.lit("000102"))).when(F.col("k") != 3, F.unhex(F.lit("00010203")))
    chunks = e.select(
        "event_id",
        k(0, 1_000_000, F.col("event_id") % 1_000_000).alias("sequence"),
        k(1, F.lit(-1), at).alias("start_ms"),
        k(2, at - 1, at).alias("end_ms"),
        pcm.alias("pcm"),
        k(4, 0, 16_000).alias("sample_rate"),
        k(5, None, 2).cast("int").alias("channels"),
        k(6, 24, 16).alias("bit_depth"),
    )
    return chunks.select("event_id", media.chunk_fault(chunks).alias("fault"))


@query("select user_id as session_id from events group by user_id having count(distinct user_id % 2 = 0 and event_id % 20 = 0) > 1")
def mixed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when((F.col("user_id") % 2 == 0) & (F.col("event_id") % 20 == 0), 8000).otherwise(16_000)
    return media.mixed_sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), rate.alias("sample_rate"), F.lit(1).alias("channels"), F.lit(16).alias("bit_depth")))


@query(
    """select q.conv_id as session_id, q.turn as at, q.text, min(f.turn) as fetched_at from conversations q
 left join conversations f on f.conv_id = q.conv_id and f.turn % 3 = 2 and f.turn >= q.turn where q.turn % 3 <> 2 group by q.conv_id, q.turn, q.text"""
)
def questions_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn fetches what the turns before it asked."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "text")
    return intervals.questions_fetched(c.where("at % 3 <> 2"), c.where("at % 3 = 2"))


@query(
    with_sql(
        "log",
        """, kept as (select id, seq from log where seq % 10 <> 0 and seq % 6 <> 1), fresh as (select 'n' || id as id, seq + 1 as seq from log where seq % 10 = 0 and seq % 20 <> 0)
 select id, seq from kept union all select id, seq + (select coalesce(max(seq), 0) from kept) from fresh""",
    )
)
def apply_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries staged and taken back, and deletions, in one transaction."""
    own = raw_log(spark, sf_dir).select("id", "seq")
    adds = own.where("seq % 10 = 0").select(F.concat(F.lit("n"), "id").alias("id"), (F.col("seq") + 1).alias("seq"))
    deletes = own.where("seq % 10 <> 0 and seq % 6 = 1").select("id").unionByName(own.where("seq % 20 = 0").select(F.concat(F.lit("n"), "id").alias("id")))
    return log.apply_transaction(own.where("seq % 10 <> 0"), adds, deletes)


@query("select user_id, event_type, count(*) as n from events group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.duplicate_keys(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    with_sql(
        "log",
        """select id, case seq % 8 when 0 then 'missing field: input' when 1 then 'missing field: creator.uuid' when 2 then 'unrecognized field' when 3 then 'invalid field: date'
 when 4 then 'not an object' when 5 then 'invalid field: creator' end as error, seq % 8 > 5 as valid from log""",
    )
)
def entry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised entries, six of eight with a fault."""
    k = F.col("seq") % 8
    uuid = F.when(k != 1, F.col("id"))
    creator = F.struct(F.lit("c").alias("name"), uuid.alias("uuid"), F.lit("1").alias("version"))
    fields = ["id", F.when(k == 3, "yesterday").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("date"), "original", F.when(k != 0, F.col("input")).alias("input")]
    whole = F.to_json(F.struct(*fields, creator.alias("creator"), F.when(k == 2, "x").alias("more")))
    flat = F.to_json(F.struct(*fields, F.lit("c").alias("creator")))
    json = F.when(k == 4, "[1]").when(k == 5, flat).otherwise(whole)
    return log.validity(raw_log(spark, sf_dir).withColumn("json", json)).select("id", "error", "valid")


# --- not to be had in SQL ----------------------------------------------------------------------------


@query()
def shortcut_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(r"^purchase\b", "bought"), (r"\bbought\b", "spent"), (r"note for user (\d+)", "by $1")]
    return tx.rewrite_shortcuts(raw_log(spark, sf_dir).select("id", "input"), rules)


@query()
def nfkd_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("key", tx.fold_question(F.col("text")))
    return c.groupBy("conv_id", "key").agg(F.min("turn").alias("turn"))
