"""Incremental graph operators over node and validity tables.

``nodes`` has id, head, args (a JSON array as text), key, freshness, created_at,
modified_at; ``valid`` has dep_id, dependent_id: the proofs that a dependent was
computed from the present value of its input; ``edges`` has id, input_id, pos.
All are DataFrames of any size; only schema templates are small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.sources.shared import dealing, meeting, settle

FRESH, STALE = "up-to-date", "potentially-outdated"

#: Steps of a closure whose tables are united before they are written as one.
_UNION_STEPS = 8


class GraphError(Exception):
    """An error of the graph's definition or state."""


class InvalidSchema(GraphError):
    pass


class CyclicGraph(InvalidSchema):
    pass


class UnknownHead(GraphError):
    pass


class ArityMismatch(GraphError):
    pass


class NotMaterialized(GraphError):
    pass


@dataclass(frozen=True)
class Pattern:
    """``head(arg, ...)``; without arguments the parentheses may be left out."""

    head: str
    args: tuple[str, ...] = ()

    def __str__(self) -> str:
        return self.head + (f"({','.join(self.args)})" if self.args else "")


def parse_pattern(text: str) -> Pattern:
    """Parse ``ident`` or ``ident(ident, ...)``; white space around parts is ignored."""
    import re

    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(?:\(\s*((?:[A-Za-z_]\w*\s*(?:,\s*[A-Za-z_]\w*\s*)*)?)\))?\s*", text, re.A)
    if not m:
        raise InvalidSchema(f"not a pattern: {text!r}")
    return Pattern(m[1], tuple(a.strip() for a in m[2].split(",")) if m[2] and m[2].strip() else ())


@dataclass(frozen=True)
class Family:
    """A node family: its pattern, the patterns of its inputs, and what its function is like."""

    output: Pattern
    inputs: tuple[Pattern, ...] = ()
    deterministic: bool = True
    side_effects: bool = False


def family(output: str, *inputs: str, deterministic: bool = True, side_effects: bool = False) -> Family:
    return Family(parse_pattern(output), tuple(map(parse_pattern, inputs)), deterministic, side_effects)


def check_schema(families: list[Family]) -> dict[str, Family]:
    """Families by head; raises on repeated variables or heads, free variables, unknown inputs, other arities and cycles."""
    by_head: dict[str, Family] = {}
    for f in families:
        if f.output.head in by_head:
            raise InvalidSchema(f"defined twice: {f.output.head}")
        if len(set(f.output.args)) < len(f.output.args):
            raise InvalidSchema(f"repeated variable: {f.output}")
        by_head[f.output.head] = f
    for f in families:
        for i in f.inputs:
            if not set(i.args) <= set(f.output.args):
                raise InvalidSchema(f"free variable in {i} of {f.output}")
            if i.head not in by_head:
                raise InvalidSchema(f"unknown input: {i}")
            if len(i.args) != len(by_head[i.head].output.args):
                raise InvalidSchema(f"arity of input: {i}")
    levels(by_head)
    return by_head


def levels(by_head: dict[str, Family]) -> dict[str, int]:
    """Longest way from a source to each head."""
    out: dict[str, int] = {}
    left = dict(by_head)
    while left:
        ready = [h for h, f in left.items() if all(i.head in out for i in f.inputs)]
        if not ready:
            raise CyclicGraph(", ".join(sorted(left)))
        for h in ready:
            out[h] = 1 + max((out[i.head] for i in left.pop(h).inputs), default=-1)
    return out


def scheme_table(spark: SparkSession, by_head: dict[str, Family]) -> DataFrame:
    """One row per input position: head, arity, pos, input_head, arg_index (positions of the output's arguments)."""
    rows = [(h, len(f.output.args), p, i.head, [f.output.args.index(a) for a in i.args]) for h, f in by_head.items() for p, i in enumerate(f.inputs)]
    return spark.createDataFrame(rows, "head string, arity int, pos int, input_head string, arg_index array<int>")


def node_key(head: F.Column, args: F.Column) -> F.Column:
    """Key of a node: its head and the exact JSON text of its arguments."""
    return F.concat(F.lit('{"head":'), F.to_json(F.array(head)).substr(F.lit(2), F.length(F.to_json(F.array(head))) - 2), F.lit(',"args":'), args, F.lit("}"))


def derive_edges(nodes: DataFrame, scheme: DataFrame) -> DataFrame:
    """Edges from nodes to the nodes of their inputs: ``id``, ``input_id``, ``pos``; of equal inputs of a node the first stays.

    Inputs' keys come from the templates of the node's head. ``input_id`` is null
    where the input is not materialized. Arguments are texts.
    """
    args = F.from_json("args", "array<string>")
    wanted = nodes.select("id", "head", args.alias("_args")).join(F.broadcast(scheme), "head")
    own = F.transform("arg_index", lambda i: F.get(F.col("_args"), i))
    keys = wanted.select("id", "pos", F.col("input_head"), F.to_json(own).alias("input_args")).withColumn("key", node_key(F.col("input_head"), F.col("input_args")))
    deal = dealing(nodes, keys)
    first = settle(deal(keys.select("id", "key", "pos"), "id", "key").groupBy("id", "key").agg(F.min("pos").alias("pos")), "wanted")
    found = meeting(first, "key", deal)(deal(nodes.select("key", "id"), "key").groupBy("key").agg(F.min("id").alias("input_id")), "left")
    return settle(found.select("id", "input_id", "pos", "key"), "edges", small=True)


def closure(start: DataFrame, steps: DataFrame, depth: int | None = None) -> DataFrame:
    """Ids reachable from ``start`` (``id``) over ``steps`` (``from_id``, ``to_id``), the start included.

    Goes on until a step finds no new id, so that cycles end too. Where a schema
    bounds the depth, new ids beyond ``depth`` steps raise ``GraphError``. Each step
    goes on with new ids only and is a written table, and now and then all that is
    reached becomes one table, so that plans do not grow with the steps.
    """
    reached = settle(start.select("id").distinct(), "reached")
    meet = meeting(settle(steps.select("from_id", "to_id"), "steps"), "from_id")
    front, taken = reached, 0
    while True:
        found = meet(front.select(F.col("id").alias("from_id"))).select(F.col("to_id").alias("id")).distinct()
        front = settle(found.join(reached, "id", "left_anti"), "front")
        if front.isEmpty():
            return reached
        taken += 1
        if depth is not None and taken > depth:
            raise GraphError(f"more than {depth} steps to {front.first()['id']}")
        reached = reached.unionByName(front)
        if taken % _UNION_STEPS == 0:
            reached = settle(reached, "reached")


def stale_closure(valid: DataFrame, changed: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that become stale with ``changed`` ones: themselves and all dependents over proofs."""
    return closure(changed, valid.select(F.col("dep_id").alias("from_id"), F.col("dependent_id").alias("to_id")), depth)


def invalidate(nodes: DataFrame, valid: DataFrame, targets: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """State after invalidation: targets and their dependents are stale, the targets' incoming proofs are gone. Unknown targets change nothing."""
    there = targets.select("id").join(nodes, "id", "left_semi")
    stale = stale_closure(valid, there, depth).withColumn("_stale", F.lit(True))
    marked = nodes.join(stale, "id", "left").withColumn("freshness", F.when(F.col("_stale"), STALE).otherwise(F.col("freshness"))).drop("_stale")
    return marked, valid.join(there.select(F.col("id").alias("dependent_id")), "dependent_id", "left_anti").select("dep_id", "dependent_id")


def cache_usable(nodes: DataFrame, edges: DataFrame, valid: DataFrame) -> DataFrame:
    """``id`` and ``usable``: the node has inputs, and a proof for each of them."""
    deal = dealing(nodes, edges, valid)
    proofs = deal(valid.select(F.col("dep_id").alias("input_id"), F.col("dependent_id").alias("id"), F.lit(1).alias("_p")), "id", "input_id")
    met = deal(edges.select("id", "input_id"), "id", "input_id").join(proofs, ["id", "input_id"], "left")
    counted = deal(met.select("id", "_p"), "id").groupBy("id").agg(F.count("*").alias("_all"), F.count("_p").alias("_with"))
    return deal(nodes.select("id"), "id").join(counted, "id", "left").select("id", F.coalesce((F.col("_all") > 0) & (F.col("_all") == F.col("_with")), F.lit(False)).alias("usable"))


def commit_computed(nodes: DataFrame, edges: DataFrame, valid: DataFrame, computed: DataFrame, now: str, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """State after nodes were computed: ``computed`` has id and value_hash (``nodes`` has value_hash as well).

    A node with its old hash is unchanged: it keeps its times and outgoing proofs
    (early cutoff). A changed one gets the time, loses its outgoing proofs, and its
    dependents are stale. Either is fresh and has proofs for all its inputs.
    """
    both = nodes.join(computed.select("id", F.col("value_hash").alias("_new")), "id", "left")
    changed = both.where(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("value_hash"))).select("id")
    done = computed.select("id").distinct()
    below = stale_closure(valid, changed, depth).join(done, "id", "left_anti").withColumn("_stale", F.lit(True))
    is_new = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("value_hash"))
    after = both.join(below, "id", "left").withColumns(
        {
            "freshness": F.when(F.col("_new").isNotNull(), FRESH).when(F.col("_stale"), STALE).otherwise(F.col("freshness")),
            "created_at": F.when(is_new, F.coalesce("created_at", F.lit(now))).otherwise(F.col("created_at")),
            "modified_at": F.when(is_new, F.lit(now)).otherwise(F.col("modified_at")),
            "value_hash": F.coalesce("_new", "value_hash"),
        }
    )
    kept = valid.join(changed.select(F.col("id").alias("dep_id")), "dep_id", "left_anti").select("dep_id", "dependent_id")
    proofs = edges.join(done, "id", "left_semi").where("input_id is not null").select(F.col("input_id").alias("dep_id"), F.col("id").alias("dependent_id"))
    # an input that changed in the same step was computed before its dependents
    return after.select(*nodes.columns), kept.unionByName(proofs).distinct()


def topological_levels(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``id`` and ``level``: the longest way from a node without inputs. Edges to absent nodes are ignored; raises ``CyclicGraph`` beyond ``depth``.

    Each round takes off the nodes that have no input left and writes the others, so plans do not grow with the rounds.
    """
    there = settle(nodes.select("id").distinct(), "there")
    inputs = meeting(settle(edges.where("input_id is not null").select("id", "input_id"), "inputs"), "input_id")
    own = inputs(there.select(F.col("id").alias("input_id")), "left_semi").join(there, "id", "left_semi").distinct()
    meet = meeting(settle(own, "own"), "input_id")
    left, out = there, []
    for level in range(depth + 1):
        blocked = settle(meet(left.select(F.col("id").alias("input_id")), "left_semi").select("id").distinct(), "blocked")
        out.append(left.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)))
        if blocked.isEmpty():
            return reduce(DataFrame.unionByName, out)
        left = blocked
    raise CyclicGraph(f"no topological order within {depth} levels")


def pull_many(by_head: dict[str, Family], head: str, wanted: DataFrame, nodes: DataFrame) -> list[tuple[str, DataFrame]]:
    """What a pull of many instances has to visit, sources first: (head, bindings that are not fresh), each binding once.

    ``wanted`` has ``args``, the JSON text of each instance's arguments.
    """
    if head not in by_head:
        raise UnknownHead(head)
    need: dict[str, DataFrame] = {head: wanted.select("args").distinct()}
    order = levels(by_head)
    for h in sorted(by_head, key=lambda x: -order[x]):
        if h not in need:
            continue
        fresh = nodes.where((F.col("head") == h) & (F.col("freshness") == FRESH)).select("args")
        need[h] = need[h].distinct().join(fresh, "args", "left_anti")
        f = by_head[h]
        for i in f.inputs:
            args = F.from_json("args", "array<string>")
            own = F.to_json(F.array(*[F.get(args, f.output.args.index(a)) for a in i.args])) if i.args else F.lit("[]")
            below = need[h].select(own.alias("args"))
            need[i.head] = need[i.head].unionByName(below) if i.head in need else below
    return [(h, need[h]) for h in sorted(need, key=lambda x: (order[x], x))]


def inspect(by_head: dict[str, Family], wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """State of wanted instances (``head``, ``args`` as JSON text) without computing anything: the other columns of ``nodes``, null where not materialized.

    Unknown heads raise ``UnknownHead``, a wrong number of arguments ``ArityMismatch``,
    a materialized node without freshness ``GraphError``. Repeated wishes give one row.
    """
    asked = wanted.select("head", "args").distinct()
    arities = asked.groupBy("head", F.size(F.from_json("args", "array<string>")).alias("n"))
    known = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(len(f.output.args)).alias("n")) for h, f in by_head.items()])
    odd = arities.agg(F.count("*")).where(~F.array_contains(known, F.struct(F.col("head").alias("h"), F.col("n").alias("n")))).first()
    if odd:
        raise ArityMismatch(f"{odd['n']} arguments of {odd['head']}") if odd["head"] in by_head else UnknownHead(odd["head"])
    found = asked.withColumn("key", node_key(F.col("head"), F.col("args"))).join(nodes.drop("head", "args"), "key", "left")
    broken = found.where("id is not null and freshness is null").first()
    if broken:
        raise GraphError(f"no freshness: {broken['key']}")
    return found


def modification_times(by_head: dict[str, Family], wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``head``, ``args``, ``created_at`` and ``modified_at`` of wanted instances; raises ``NotMaterialized`` if any is not there."""
    found = inspect(by_head, wanted, nodes)
    missing = found.where("id is null").first()
    if missing:
        raise NotMaterialized(missing["key"])
    return found.select("head", "args", "created_at", "modified_at")


def default_families() -> dict[str, Family]:
    """The engine's own graph of log, orders, contexts and media."""
    return check_schema(
        [
            family("config"),
            family("ontology"),
            family("all_events"),
            family("sorted_events_descending", "all_events"),
            family("sorted_events_ascending", "sorted_events_descending"),
            family("last_entries(n)", "sorted_events_descending"),
            family("first_entries(n)", "sorted_events_ascending"),
            family("events_count", "all_events"),
            family("meta_events", "all_events"),
            family("event_context", "meta_events"),
            family("event(e)", "all_events"),
            family("basic_context(e)", "all_events"),
            family("calories(e)", "basic_context(e)", deterministic=False, side_effects=True),
            family("transcription(a)", deterministic=False, side_effects=True),
            family("event_audios_list(e)", "event(e)", deterministic=False, side_effects=True),
            family("event_transcription(e, a)", "event(e)", "transcription(a)"),
            family("entry_description(e)", "event(e)"),
            family("diary_most_important_info_summary"),
        ]
    )


def violations(nodes: DataFrame, valid: DataFrame, edges: DataFrame) -> DataFrame:
    """Broken invariants of a state: ``rule`` and ``id``. An empty result is a sound state.

    Ids and keys are unique, times are there and in order, all inputs exist, proofs
    are along edges, and a fresh node has fresh inputs and a proof of each.
    """
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("id").cast("string").alias("id"))
    fresh = nodes.where(F.col("freshness") == FRESH).select("id")
    edges = settle(edges.select("id", "input_id"), "edges")
    ends = valid.select(F.col("dependent_id").alias("id"), F.col("dep_id").alias("input_id"))
    own = settle(edges.join(fresh, "id", "left_semi"), "fresh")
    return (
        rule(nodes.groupBy("id").count().where("count > 1"), "duplicate id")
        .unionByName(rule(nodes.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1"), "duplicate key"))
        .unionByName(rule(nodes.where("created_at is null or modified_at is null or created_at > modified_at"), "times"))
        .unionByName(rule(edges.where("input_id is null"), "missing input"))
        .unionByName(rule(ends.join(edges, ["id", "input_id"], "left_anti"), "proof without edge"))
        .unionByName(rule(meeting(own, "input_id")(fresh.select(F.col("id").alias("input_id")), "left_anti"), "fresh on stale input"))
        .unionByName(rule(own.join(ends, ["id", "input_id"], "left_anti"), "fresh without proof"))
    )


def allocate_ids(keys: DataFrame, last_index: int, fingerprint: str) -> DataFrame:
    """New ids for keys, in the order of the keys: base-36 numbers after ``last_index`` and the replica's fingerprint."""
    lanes = keys.select("key").distinct().withColumn("_lane", F.substring(F.md5("key"), 1, 2))
    counts = lanes.groupBy("_lane").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_lane")) - F.col("_n"))
    ranked = lanes.withColumn("_at", F.row_number().over(Window.partitionBy("_lane").orderBy("key"))).join(F.broadcast(before), "_lane")
    index = F.col("_before") + F.col("_at") + last_index
    return ranked.select("key", F.concat(F.lower(F.conv(index.cast("string"), 10, 36)), F.lit(f"-{fingerprint}")).alias("id"))
