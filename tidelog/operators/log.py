"""Event-log operators: search, order, pages, lookups, context, additions and deletions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.sources.shared import settle

#: Entries of up to so many tags are counted by combinations of tags, others by pairs.
COMBINED_TAGS = 8

#: Rows that meet a copy of a tag's list.
LOT_ROWS = 500

#: Copies of lists beside the first of each tag, and entries of the lists that a task gets, about.
COPIES, LIST_ENTRIES = 200, 20_000

#: Types of entries that are context for others.
CONTEXT_TYPES = ("register", "text", "photo")
DIARY = "diary"


class InvalidSearch(ValueError):
    """The search pattern is no regular expression."""


class InvalidPage(ValueError):
    """A page argument is out of range."""


class EntryNotFound(LookupError):
    """No entry has this id."""


def search(log: DataFrame, pattern: str | None) -> DataFrame:
    """Parsed entries whose type or description matches ``pattern``, case ignored; no pattern keeps all."""
    if not pattern:
        return log
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidSearch(str(e)) from e
    p = f"(?iu){pattern}"
    return log.where(F.coalesce(F.col("type").rlike(p), F.lit(False)) | F.coalesce(F.col("description").rlike(p), F.lit(False)))


def order_keys(order: str = "desc", mode: str = "lexical") -> list[Column]:
    """Sort keys: the date, ties in log order (``desc``), or the exact reverse (``asc``).

    ``lexical`` compares dates as texts under the Unicode collation, ``chronological`` as instants (column ``ts``).
    """
    date = F.collate(F.col("date"), "UNICODE") if mode == "lexical" else F.col("ts")
    if order not in ("asc", "desc") or mode not in ("lexical", "chronological"):
        raise InvalidPage(f"unknown order: {order}, {mode}")
    return [date.desc(), F.col("seq").asc()] if order == "desc" else [date.asc(), F.col("seq").desc()]


def first_entries(log: DataFrame, n: int, order: str = "asc", mode: str = "lexical") -> DataFrame:
    """First ``n`` entries of an order; the last ones are the first of ``desc``."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise InvalidPage(f"not a number of entries: {n}")
    return log.orderBy(*order_keys(order, mode)).limit(n)


def page(log: DataFrame, page: int = 1, limit: int = 20, order: str = "desc", pattern: str | None = None, mode: str = "lexical") -> DataFrame:
    """Rows of a page of matching entries, and one more if there are more."""
    if page < 1 or not 1 <= limit <= 100:
        raise InvalidPage(f"page {page} of {limit}")
    return search(log, pattern).orderBy(*order_keys(order, mode)).offset((page - 1) * limit).limit(limit + 1)


def page_arguments(query: dict[str, list[str] | str]) -> dict:
    """Page arguments of a URL query: the first of repeated ones, defaults for what is missing or not a number, limits kept."""

    def first(name: str) -> str | None:
        v = query.get(name)
        return v[0] if isinstance(v, list) and v else v if isinstance(v, str) else None

    def number(name: str, default: int) -> int:
        m = re.match(r"\s*([+-]?\d+)", first(name) or "")
        return int(m[1]) if m and int(m[1]) != 0 else default

    orders = {"dateAscending": "asc", "dateDescending": "desc"}
    return {"page": max(1, number("page", 1)), "limit": min(100, max(1, number("limit", 20))), "order": orders.get(first("order"), "desc"), "pattern": first("search") or None}


def lookup(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested ids (column ``id``) with their entry; ``found`` tells if there is one."""
    own = log.withColumn("found", F.lit(True))
    return requests.select("id").join(own, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get_event(log: DataFrame, id_: str) -> DataFrame:
    """The entry with an id; raises ``EntryNotFound`` without one."""
    one = log.where(F.col("id") == id_)
    if one.isEmpty():
        raise EntryNotFound(id_)
    return one


def entry_description(log: DataFrame) -> DataFrame:
    """``id`` and the description of diary entries; null for other types and blank ones."""
    return log.select("id", F.when(F.col("type") == DIARY, tx.blank_to_null(F.col("description"))).alias("entry_description"))


def events_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"))


def tag_counts(log: DataFrame) -> DataFrame:
    """Entries of each tag."""
    return log.select("id", F.explode("hashtags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def context_pairs(log: DataFrame, targets: DataFrame | None = None, types: tuple[str, ...] = CONTEXT_TYPES) -> DataFrame:
    """Pairs of an entry (``e_id``) and each entry of its context (``o_id``, ``o_seq``).

    The context of an entry is itself and the entries of context types that share a
    tag with it. Both sides are exploded to tags and meet in an equi-join. The result
    is as large as all contexts together; ``context_sizes`` counts without it.
    """
    own = log if targets is None else log.join(targets.select("id").distinct(), "id", "left_semi")
    left = own.select(F.col("id").alias("e_id"), F.explode("hashtags").alias("tag"))
    right = log.where(F.col("type").isin(*types)).select(F.col("id").alias("o_id"), F.col("seq").alias("o_seq"), F.explode("hashtags").alias("tag"))
    shared = left.join(right, "tag").select("e_id", "o_id", "o_seq")
    return shared.unionByName(own.select(F.col("id").alias("e_id"), F.col("id").alias("o_id"), F.col("seq").alias("o_seq"))).distinct()


def with_context(rows: DataFrame, log: DataFrame, types: tuple[str, ...] = CONTEXT_TYPES, told: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """``rows`` (``id``, each once, and any columns) with ``context``: ``o_seq``, ``o_id`` and the ``told`` columns of the entries of its context, in log order; null for unknown ids, or without these if ``how`` is ``inner``.

    As large as all contexts together, but no pairs are shuffled. Entries of a tag
    are listed once. A row meets the list of its most frequent tag last, and what its
    other tags add (entries without a more frequent tag of the row) goes there with
    it. Rows of a tag are dealt into lots of about ``LOT_ROWS``, and each lot gets the
    list. Lots grow where there would be over ``COPIES`` more lists than tags, and a
    task has few lists, so that neither disk nor a task's memory grows faster than the lists.
    Where rows are sorted to meet lists, those with long ones come first: writers of Parquet
    guess from the rows so far how many to hold, so that short rows, or unknown ids, before
    long ones would take up all memory.
    """
    context = F.coalesce(F.col("type").isin(*types), F.lit(False))
    tags = F.coalesce(F.array_distinct("hashtags"), F.array().cast("array<string>"))
    entry = F.struct(F.col("seq").alias("o_seq"), F.col("id").alias("o_id"), *told)
    rows = settle(rows, "rows")
    own = settle(log.select("id", context.alias("is_context"), tags.alias("tags"), entry.alias("o")), "tagged")
    tagged = own.where("is_context").select("o", "tags", F.explode("tags").alias("tag"))
    asked = own.join(rows.select("id"), "id", "left_semi").groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"),
        F.collect_set(F.when(~F.col("is_context") | (F.size("tags") == 0), F.col("o"))).alias("itself"),
    )
    sizes = settle(tagged.groupBy("tag").agg(F.count("*").alias("n")), "sizes")
    frequent = asked.select("id", F.explode("tags").alias("tag")).join(sizes, "tag")
    ranked = frequent.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "tag")), asc=False), lambda x: x["tag"]).alias("ranked"))
    asked = settle(asked.join(ranked, "id", "left").select("id", "itself", "ranked"), "asked")

    met = asked.select("id", "ranked", F.posexplode("ranked").alias("at", "tag")).withColumn("last", F.col("at") == 0)
    made = met.groupBy("tag", "last").agg(F.count("*").alias("rows")).join(sizes, "tag").withColumn("made", F.col("rows") * F.col("n").cast("double"))
    total = F.broadcast(made.groupBy("last").agg(F.sum("made").alias("total")))
    lots = settle(made.join(total, "last").select("tag", "last", "n", F.least(F.ceil(F.col("rows") / LOT_ROWS), 1 + F.floor(COPIES * F.col("made") / F.col("total"))).alias("lots")), "lots")
    tasks = {r["last"]: min(2 * r["lists"], -(-r["entries"] // LIST_ENTRIES)) for r in lots.groupBy("last").agg(F.sum("lots").alias("lists"), F.sum(F.col("lots") * F.col("n")).alias("entries")).collect()}
    lot = F.pmod(F.xxhash64("id"), F.coalesce("lots", F.lit(LOT_ROWS))).alias("lot")
    rank = F.coalesce(-F.col("n"), F.lit(0)).alias("rank")
    listed = tagged.groupBy("tag").agg(F.sort_array(F.collect_set(F.struct("o", "tags"))).alias("list")).join(lots, "tag").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))).withColumn("rank", rank)
    bare = lambda x: F.transform(x, lambda e: e["o"])

    def meet(many: DataFrame, lists: DataFrame, last: bool, how: str) -> DataFrame:
        n = tasks.get(last, 0)
        deal = lambda df: df.repartition(n, "rank", "tag", "lot") if n > df.sparkSession.sparkContext.defaultParallelism else df
        return deal(many).join(deal(lists), ["rank", "tag", "lot"], how)

    others = met.where("not last").join(lots.where("not last"), "tag").select("id", "tag", F.slice("ranked", F.lit(1), F.col("at")).alias("before"), rank, lot)
    new = F.filter("list", lambda e: ~F.arrays_overlap(e["tags"], F.col("before")))
    added = meet(others, listed.where("not last").select("rank", "tag", "lot", "list"), False, "inner").select("id", bare(new).alias("more")).groupBy("id").agg(F.flatten(F.collect_list("more")).alias("more"))
    none = F.array().cast(own.select(F.array("o").alias("x")).schema["x"].dataType)
    known = asked.join(added, "id", "left").select("id", F.get("ranked", F.lit(0)).alias("tag"), F.concat("itself", F.coalesce("more", none)).alias("more"))
    last = rows.join(known, "id", how).join(lots.where("last").select("tag", "n", "lots"), "tag", "left").select(*rows.columns, "tag", "more", rank, lot)
    found = meet(last, listed.where("last").select("rank", "tag", "lot", bare(F.col("list")).alias("list")), True, "left")
    return found.select(*rows.columns, F.sort_array(F.concat(F.coalesce("list", none), "more")).alias("context"))


def event_context(log: DataFrame, targets: DataFrame | None = None, types: tuple[str, ...] = CONTEXT_TYPES) -> DataFrame:
    """``e_id`` and ``context``: ids of its context in log order. Entries are told by id and place."""
    asked = (log if targets is None else targets).select("id").distinct()
    return with_context(asked, log, types, how="inner").select(F.col("id").alias("e_id"), F.transform("context", lambda x: x["o_id"]).alias("context"))


def context_sizes(log: DataFrame, types: tuple[str, ...] = CONTEXT_TYPES) -> DataFrame:
    """``e_id`` and ``n``: the size of every entry's context, counted without its pairs; ids are unique.

    Entries that share a tag with one are counted by inclusion and exclusion: for
    each combination of its tags, the context entries that have all of these, added
    for odd combinations and taken off for even ones. Combinations are counted
    before they meet the entries, so that a frequent tag costs no more than a rare
    one. Entries of more than ``COMBINED_TAGS`` tags have too many combinations;
    they meet others, as entries and as context, in pairs. No tags, or null: itself only.
    """
    context = F.coalesce(F.col("type").isin(*types), F.lit(False))
    tags = F.coalesce(F.array_sort(F.array_distinct("hashtags")), F.array().cast("array<string>"))
    own = settle(log.select("id", context.alias("is_context"), tags.alias("tags")), "tagged")
    few, many = own.where(F.size("tags") <= COMBINED_TAGS), own.where(F.size("tags") > COMBINED_TAGS)
    part = F.explode(F.expr("transform(sequence(1, shiftleft(1, size(tags)) - 1), m -> filter(tags, (t, i) -> (shiftright(m, i) & 1) = 1))")).alias("part")
    combined = few.where(F.size("tags") > 0).select("id", "is_context", part)
    counts = combined.where("is_context").groupBy("part").agg(F.count("*").alias("n"))
    shared = combined.select("id", "part").join(counts, "part").select("id", F.when(F.size("part") % 2 == 1, F.col("n")).otherwise(-F.col("n")).alias("n"))
    itself = own.select("id", F.when(F.col("is_context") & (F.size("tags") > 0), 0).otherwise(1).cast("bigint").alias("n"))
    out = itself.unionByName(shared)
    if not many.isEmpty():
        tagged = lambda df, as_: df.select(F.col("id").alias(as_), F.explode("tags").alias("tag"))
        met = [(many, own.where("is_context")), (few, many.where("is_context"))]
        for left, right in met:
            pairs = tagged(left, "id").join(tagged(right, "o_id"), "tag").select("id", "o_id").distinct()
            out = out.unionByName(pairs.select("id", F.lit(1).cast("bigint").alias("n")))
    return out.groupBy(F.col("id").alias("e_id")).agg(F.sum("n").alias("n"))


def context_or_self(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """Requested ids with their stored context, or only themselves without one."""
    joined = requests.select(F.col("id").alias("e_id")).join(contexts, "e_id", "left")
    return joined.select("e_id", F.coalesce("context", F.array("e_id")).alias("context"))


def ontology_filter(types: DataFrame, modifiers: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types that occur in a context, and modifiers that are for all types or for one of those."""
    there = context.select("type").distinct()
    kept = modifiers.where(F.col("only_for_type").isNull()).unionByName(modifiers.join(there, modifiers.only_for_type == there.type, "left_semi"))
    return types.join(there, types.name == there.type, "left_semi"), kept


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """New entries after all others; ``new`` has an order column ``seq`` of its own, from 1."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    shifted = new.join(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("_top")).drop("_top")
    return log.unionByName(shifted)


def delete_events(log: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """The log without some ids; with ``strict`` an unknown id raises ``EntryNotFound``."""
    if strict:
        unknown = ids.select("id").join(log, "id", "left_anti").first()
        if unknown:
            raise EntryNotFound(unknown["id"])
    return log.join(ids.select("id"), "id", "left_anti")


def apply_transaction(log: DataFrame, adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """Staged additions and deletions: what is left, then what is new; deleting a staged addition takes it back."""
    known = log.select("id").unionByName(adds.select("id"))
    unknown = deletes.select("id").join(known, "id", "left_anti").first()
    if unknown:
        raise EntryNotFound(unknown["id"])
    return append_events(delete_events(log, deletes), delete_events(adds, deletes))


def validity(raw: DataFrame, column: str = "json") -> DataFrame:
    """Check of serialised entries against the closed schema: ``valid`` and ``error`` of each JSON text."""
    fields = ["id", "date", "original", "input", "creator"]
    j = F.col(column)
    keys = F.json_object_keys(j)
    error = F.when(keys.isNull(), "not an object")
    for f in fields:
        error = error.when(~F.array_contains(keys, f), f"missing field: {f}")
    for f in fields[:4]:
        error = error.when(F.get_json_object(F.concat(F.lit("["), F.to_json(F.struct(F.get_json_object(j, f"$.{f}").alias("v"))), F.lit("]")), "$[0].v").isNull(), f"invalid field: {f}")
    error = error.when(F.json_object_keys(F.get_json_object(j, "$.creator")).isNull(), "invalid field: creator")
    for f in ("name", "uuid", "version"):
        error = error.when(F.get_json_object(j, f"$.creator.{f}").isNull(), f"missing field: creator.{f}")
    error = error.when(F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))) > 0, "unrecognized field")
    error = error.when(F.try_to_timestamp(F.get_json_object(j, "$.date")).isNull(), "invalid field: date")
    return raw.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
