"""Merge of two replicas' graph states, and migration of a state between schemas.

A replica is ``nodes`` (key, id, freshness, created_at, modified_at, fingerprint) and
``edges`` by key (key, input_key); T is the own side, H the other host's.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.graph import FRESH, STALE, GraphError, closure
from tidelog.sources.shared import settle

KEEP, TAKE, INVALIDATE, DELETE = "keep", "take", "invalidate", "delete"


class MergeError(Exception):
    """Replicas that cannot be merged."""


class HostFailures(MergeError):
    """Hosts that could not be merged, with the ``state`` after the others."""

    def __init__(self, failures: dict[str, str], state: Replica) -> None:
        super().__init__("; ".join(f"{h}: {m}" for h, m in failures.items()))
        self.failures, self.state = failures, state


@dataclass(frozen=True)
class Replica:
    """A host's state: ``nodes``, ``edges`` (key, input_key), ``valid`` (dep_key, key), and what tells hosts and schemas apart."""

    nodes: DataFrame
    edges: DataFrame
    valid: DataFrame
    version: str
    scheme: str
    fingerprint: str


class MigrationConflict(Exception):
    """Decisions about a node contradict each other or are missing."""


def _order(side: str) -> Column:
    return F.struct(F.unix_millis(F.to_timestamp(f"{side}_modified_at")), F.col(f"{side}_id"), F.col(f"{side}_fingerprint"))


def check_mergeable(t: dict[str, str], h: dict[str, str]) -> None:
    """Versions and schemes must be equal, fingerprints different."""
    for what in ("version", "scheme"):
        if t[what] != h[what]:
            raise MergeError(f"{what}: {t[what]} and {h[what]}")
    if t["fingerprint"] == h["fingerprint"]:
        raise MergeError("both sides have the same fingerprint")


def id_collisions(t: DataFrame, h: DataFrame) -> DataFrame:
    """Ids that stand for different keys on the two sides."""
    a, b = t.select("id", F.col("key").alias("t_key")), h.select("id", F.col("key").alias("h_key"))
    return a.join(b, "id").where("t_key <> h_key")


def select_candidates(t: DataFrame, h: DataFrame) -> DataFrame:
    """Every key of either side with the side that wins by (modified_at, id, fingerprint).

    ``side`` is T or H; ``root`` tells that both sides have the key and differ in
    that order, so that what depends on the loser's value is tainted.
    """
    fields = ("id", "freshness", "created_at", "modified_at", "fingerprint")
    a = t.select("key", *[F.col(f).alias(f"t_{f}") for f in fields])
    b = h.select("key", *[F.col(f).alias(f"h_{f}") for f in fields])
    both = a.join(b, "key", "full_outer")
    side = F.when(F.col("h_id").isNull(), "T").when(F.col("t_id").isNull(), "H").when(_order("t") >= _order("h"), "T").otherwise("H")
    root = F.col("t_id").isNotNull() & F.col("h_id").isNotNull() & (_order("t") != _order("h"))
    return both.withColumn("side", side).withColumn("root", root)


def taint(selected: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Keys with the taints they carry: ``key``, ``taint`` (T or H), from roots down to all dependents."""
    steps = edges.select(F.col("input_key").alias("from_id"), F.col("key").alias("to_id"))
    out = None
    for side in ("T", "H"):
        reached = closure(selected.where(F.col("root") & (F.col("side") == side)).select(F.col("key").alias("id")), steps, depth).select(F.col("id").alias("key"), F.lit(side).alias("taint"))
        out = reached if out is None else out.unionByName(reached)
    return out


def invalidation_candidates(selected: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Keys whose chosen value may not fit the merged inputs.

    They carry a taint of the side they are not from, or an input whose chosen
    version is not the one on their own side, or both sides have the same version
    and one of them is stale.
    """
    torn = taint(selected, edges, depth).join(selected.select("key", "side"), "key").where("taint <> side").select("key")
    final = F.when(F.col("side") == "T", F.col("t_id")).otherwise(F.col("h_id"))
    inputs = selected.select(F.col("key").alias("input_key"), F.col("side").alias("in_side"), final.alias("in_id"), F.col("t_id").alias("in_t"), F.col("h_id").alias("in_h"))
    own = edges.join(selected.select("key", "side"), "key").join(inputs, "input_key")
    other = own.where((F.col("side") != F.col("in_side")) | ~F.when(F.col("side") == "T", F.col("in_t")).otherwise(F.col("in_h")).eqNullSafe(F.col("in_id"))).select("key")
    same = (F.unix_millis(F.to_timestamp("t_modified_at")) == F.unix_millis(F.to_timestamp("h_modified_at"))) & (F.col("t_id") == F.col("h_id"))
    chosen = F.when(F.col("side") == "T", F.col("t_freshness")).otherwise(F.col("h_freshness"))
    doubtful = selected.where(same & (chosen == FRESH) & ((F.col("t_freshness") == STALE) | (F.col("h_freshness") == STALE))).select("key")
    return torn.unionByName(other).unionByName(doubtful).distinct()


def deletion_closure(candidates: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Keys to delete: candidates with more than one distinct input, and all that depends on them."""
    several = edges.groupBy("key").agg(F.countDistinct("input_key").alias("n")).where("n > 1")
    roots = candidates.select("key").join(several, "key", "left_semi").select(F.col("key").alias("id"))
    return closure(roots, edges.select(F.col("input_key").alias("from_id"), F.col("key").alias("to_id")), depth).select(F.col("id").alias("key"))


def merge_outcomes(t: DataFrame, h: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Plan of a merge: ``key``, ``side`` and ``outcome`` (delete before invalidate before keep or take)."""
    selected = settle(select_candidates(t, h), "selected")
    candidates = settle(invalidation_candidates(selected, edges, depth), "candidates")
    gone = deletion_closure(candidates, edges, depth).withColumn("_gone", F.lit(True))
    bad = candidates.withColumn("_bad", F.lit(True))
    outcome = F.when(F.col("_gone"), DELETE).when(F.col("_bad"), INVALIDATE).when(F.col("side") == "T", KEEP).otherwise(TAKE)
    return selected.join(gone, "key", "left").join(bad, "key", "left").withColumn("outcome", outcome).drop("_gone", "_bad")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def apply_outcomes(outcomes: DataFrame) -> DataFrame:
    """Merged nodes: the chosen side's row, stale where invalidated, its times as they were."""
    pick = lambda f: F.when(F.col("side") == "T", F.col(f"t_{f}")).otherwise(F.col(f"h_{f}"))
    freshness = F.when(F.col("outcome") == INVALIDATE, STALE).otherwise(pick("freshness"))
    return outcomes.where(F.col("outcome") != DELETE).select("key", pick("id").alias("id"), freshness.alias("freshness"), *[pick(f).alias(f) for f in ("created_at", "modified_at", "fingerprint")])


def transport_proofs(outcomes: DataFrame, edges: DataFrame, t_valid: DataFrame, h_valid: DataFrame) -> DataFrame:
    """Proofs (``dep_key``, ``key``) that hold in the merged state.

    A proof stays if both ends were chosen from its side, it is along an edge, and
    its dependent is neither deleted nor invalidated.
    """
    alive = outcomes.where(F.col("outcome") != DELETE).select("key", "side", "outcome")
    out = None
    for side, valid in (("T", t_valid), ("H", h_valid)):
        there = alive.where(F.col("side") == side)
        own = valid.join(there.select(F.col("key").alias("dep_key")), "dep_key", "left_semi").join(there.where(F.col("outcome") != INVALIDATE).select("key"), "key", "left_semi")
        own = own.join(edges.select("key", F.col("input_key").alias("dep_key")), ["key", "dep_key"], "left_semi").select("dep_key", "key")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def settle_freshness(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes after everything that depends on a stale one is stale as well."""
    start = nodes.where(F.col("freshness") == STALE).select(F.col("key").alias("id"))
    stale = closure(start, edges.select(F.col("input_key").alias("from_id"), F.col("key").alias("to_id")), depth).select(F.col("id").alias("key"), F.lit(True).alias("_s"))
    return nodes.join(stale, "key", "left").withColumn("freshness", F.when(F.col("_s"), STALE).otherwise(F.col("freshness"))).drop("_s")


def merge_replicas(t: Replica, h: Replica, depth: int | None = None) -> tuple[Replica, bool]:
    """Merge of a host's state H into the own state T, and whether anything changed; without a change T itself comes back.

    Versions and schemes must be equal, fingerprints different, and no id may stand
    for different keys; else ``MergeError``. Nodes that depend on stale ones are stale.
    """
    told = lambda r: {"version": r.version, "scheme": r.scheme, "fingerprint": r.fingerprint}
    check_mergeable(told(t), told(h))
    clash = id_collisions(t.nodes, h.nodes).first()
    if clash:
        raise MergeError(f"id {clash['id']} stands for {clash['t_key']} and {clash['h_key']}")
    own, other = (r.nodes.withColumn("fingerprint", F.lit(r.fingerprint)) for r in (t, h))
    edges = settle(t.edges.select("key", "input_key").unionByName(h.edges.select("key", "input_key")).distinct(), "edges")
    plan = settle(merge_outcomes(own, other, edges, depth), "plan")
    left = edges.join(plan.where(F.col("outcome") != DELETE), "key", "left_semi")
    nodes = settle(settle_freshness(apply_outcomes(plan), left, depth), "nodes")
    valid = settle(transport_proofs(plan, edges, t.valid, h.valid), "valid")
    differ = lambda a, b: not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
    state = lambda n: n.select("key", "id", "freshness", "modified_at")
    changed = differ(state(nodes), state(t.nodes)) or differ(valid.select("dep_key", "key"), t.valid.select("dep_key", "key").distinct())
    return (replace(t, nodes=nodes, edges=left, valid=valid), True) if changed else (t, False)


def merge_hosts(own: Replica, hosts: dict[str, Replica], depth: int | None = None) -> Replica:
    """Merge hosts one after the other, in the order of their names; the order matters, as each merge is into the state after the last.

    A host that fails does not stop the others; ``HostFailures`` tells of all such at the end.
    """
    failures: dict[str, str] = {}
    for name in sorted(hosts):
        try:
            own, _ = merge_replicas(own, hosts[name], depth)
        except (MergeError, GraphError) as e:
            failures[name] = str(e)
    if failures:
        raise HostFailures(failures, own)
    return own


def migration_decisions(decided: DataFrame, old_nodes: DataFrame) -> DataFrame:
    """One decision for each old node; raises ``MigrationConflict`` on contradicting or missing ones, or on unknown nodes.

    ``decided`` has key and decision (keep, override, invalidate, delete). Equal
    decisions are one, except for overrides, which conflict even with each other.
    """
    per_key = decided.groupBy("key").agg(F.countDistinct("decision").alias("kinds"), F.count_if(F.col("decision") == "override").alias("overrides"), F.first("decision").alias("decision"))
    bad = per_key.where("kinds > 1 or overrides > 1").first()
    if bad:
        raise MigrationConflict(f"decisions about {bad['key']}")
    missing = undecided(decided, old_nodes).first()
    if missing:
        raise MigrationConflict(f"no decision about {missing['key']}")
    unknown = per_key.join(old_nodes, "key", "left_anti").first()
    if unknown:
        raise MigrationConflict(f"no such node: {unknown['key']}")
    return per_key.select("key", "decision")


def undecided(decided: DataFrame, old_nodes: DataFrame) -> DataFrame:
    return old_nodes.select("key").join(decided, "key", "left_anti")


def propagate_migration(decisions: DataFrame, old_valid: DataFrame, new_edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Decisions with what follows from them: deletes go down the new schema's edges, invalidations down the old proofs.

    A deletion replaces an invalidation that only followed from another one.
    ``explicit`` tells decisions from consequences; one that conflicts with an
    explicit decision to keep or override raises ``MigrationConflict``.
    """
    down = new_edges.select(F.col("input_key").alias("from_id"), F.col("key").alias("to_id"))
    gone = closure(decisions.where("decision = 'delete'").select(F.col("key").alias("id")), down, depth).select(F.col("id").alias("key"))
    clash = gone.join(decisions.where("decision in ('keep', 'override')"), "key", "left_semi").first()
    if clash:
        raise MigrationConflict(f"kept, but an input is deleted: {clash['key']}")
    proofs = old_valid.select(F.col("dep_key").alias("from_id"), F.col("key").alias("to_id"))
    stale = closure(decisions.where("decision in ('invalidate', 'override')").select(F.col("key").alias("id")), proofs, depth).select(F.col("id").alias("key"))
    marked = decisions.join(gone.withColumn("_gone", F.lit(True)), "key", "left").join(stale.withColumn("_stale", F.lit(True)), "key", "left")
    final = F.when(F.col("_gone"), "delete").when(F.col("_stale") & (F.col("decision") == "keep"), "invalidate").otherwise(F.col("decision"))
    return marked.select("key", final.alias("decision"), (final == F.col("decision")).alias("explicit"))


def desired_valid(final: DataFrame, old_valid: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Proofs after a migration: old ones along edges of both schemas, between nodes that stay, into dependents that are kept."""
    stay = final.where("decision <> 'delete'").select(F.col("key").alias("dep_key"))
    kept = final.where("decision = 'keep'").select("key")
    edge = lambda e: e.select("key", F.col("input_key").alias("dep_key"))
    own = old_valid.join(kept, "key", "left_semi").join(stay, "dep_key", "left_semi")
    return own.join(edge(old_edges), ["key", "dep_key"], "left_semi").join(edge(new_edges), ["key", "dep_key"], "left_semi").select("dep_key", "key").distinct()


def keep_all(nodes: DataFrame, heads: list[str]) -> DataFrame:
    """Default policy: nodes of known heads are kept, others deleted."""
    return nodes.select("key", F.when(F.col("head").isin(heads), "keep").otherwise("delete").alias("decision"))


def incompatible(old_scheme: DataFrame, new_scheme: DataFrame) -> DataFrame:
    """Heads of the old scheme that are gone, have another arity or other inputs in the new one."""
    shape = lambda s, n: s.groupBy("head").agg(F.max("arity").alias(f"{n}_arity"), F.array_sort(F.collect_list(F.struct("pos", "input_head", "arg_index"))).alias(n))
    both = shape(old_scheme, "old").join(shape(new_scheme, "new"), "head", "left")
    reason = F.when(F.col("new").isNull(), "missing").when(F.col("old_arity") != F.col("new_arity"), "arity").when(F.col("old") != F.col("new"), "inputs")
    return both.select("head", reason.alias("reason")).where("reason is not null")
