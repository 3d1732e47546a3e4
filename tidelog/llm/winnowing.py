"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a gram, and grams in a window (a power of two): texts that share GRAM + WINDOW - 1 words in a row share a selected gram.
GRAM, WINDOW = 2, 8
_LOW = (1 << 32) - 1
_FIRST = -(1 << 63)


def tokens(text: Column) -> Column:
    """Words between ASCII white space; null: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def _least_of_two(name: str, reach: int) -> Column:
    return F.transform(name, lambda x, i: F.least(x, F.get(name, i - reach)))


def with_picks(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``name``: the selected grams of column ``text`` in the order of their places.

    Each is one long: 31 bits of the gram's hash above 32 bits that fall with its
    position. A window of ``window`` grams selects the smallest hash, of equal ones
    the rightmost: that is the least long. The first windows are short, so the first
    gram is always selected and texts of few words have a fingerprint. A window's
    minimum comes from those of two windows of half its size. A text of fewer than
    ``gram`` words is one gram.
    """
    if window & (window - 1) or gram < 1:
        raise ValueError("window must be a power of two, gram positive")
    df = df.withColumn(name, tokens(F.col(text)))
    words = F.col(name)
    grams = F.transform(words, lambda w, i: F.shiftleft(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, gram)]).bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(F.lit(_LOW) - i))
    df = df.withColumn(name, F.slice(grams, 1, F.greatest(F.size(words) - (gram - 1), F.least(F.size(words), F.lit(1)))))
    reach = 1
    while reach < window:
        df = df.withColumn(name, _least_of_two(name, reach))
        reach *= 2
    return df.withColumn(name, F.array_distinct(name))


def hashes(selected: Column) -> Column:
    return F.transform(selected, lambda x: F.shiftright(x, 32))


def places(selected: Column) -> Column:
    """Word positions, from 0."""
    return F.transform(selected, lambda x: F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW)))


def digest(selected: Column) -> Column:
    """Eight hex digits for each selected gram."""
    return F.array_join(F.transform(hashes(selected), lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Common distinct hashes over all distinct hashes of two fingerprints; 1 for two texts without words."""
    union = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(hashes(a), hashes(b))) / union)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``hashes`` and ``places`` (array<bigint>) of every row.

    Null and empty texts have no hashes. Each row is judged by itself, so repeated
    rows, null ids and an empty table need no rule. Other columns are not read.
    """
    df = with_picks(docs.select("doc_id", F.col("text").alias("_text")), "_text", "_picks", gram, window)
    return df.select("doc_id", hashes(F.col("_picks")).alias("hashes"), places(F.col("_picks")).alias("places"))


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``add(docs)`` with ``next``: the columns of the following row as a struct.

    ``docs`` has ``doc_id`` and ``text`` (not null). Rows follow each other by doc_id
    (nulls first), then text; after the last comes the first. They are split by
    quantiles of doc_id into as many stretches as there are shuffle partitions, each
    sorted by a task of its own; a copy of a stretch's first row closes the one
    before. Only the lowest doc_id of each stretch comes to the driver.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)))
    cuts = docs.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] if parts > 1 else []

    def numbers(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    cuts = sorted(set(cuts or []))
    docs = docs.withColumn("_part", F.size(F.filter(numbers(cuts), lambda c: c < F.col("_key"))) if cuts else F.lit(0))
    lows = sorted((r[1], r[0]) for r in docs.groupBy("_part").agg(F.min("_key")).collect())
    rows = add(docs).withColumn("_ghost", F.lit(0))
    if lows:
        keys, before = [k for k, _ in lows], [p for _, p in lows[-1:] + lows[:-1]]
        heads = add(docs.where(F.col("_key").isin(keys)))
        ghosts = heads.withColumn("_part", F.element_at(F.map_from_arrays(numbers(keys), numbers(before)), F.col("_key")).cast("int")).withColumn("_ghost", F.lit(1))
        rows = rows.unionByName(ghosts)
    whole = F.struct(*[F.col(c) for c in rows.columns if not c.startswith("_")])
    order = Window.partitionBy("_part").orderBy("_ghost", "_key", "text")
    return rows.withColumn("next", F.lead(whole).over(order)).where("_ghost = 0").drop("_ghost", "_part", "_key")


def compare_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    In the edited text the last quarter of the code points, rounded down, is
    replaced by as many from the start of the next document (or all of it), in
    ascending doc_id; after the last document comes the first. Returns ``doc_id``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (eight hex
    digits for each selected gram), ``near_edited`` and ``near_next``.

    Null texts count as empty; two texts without words are alike (1.0). Rows of
    equal or null doc_id follow each other by text; repeated rows stay. A single
    row is its own next one. An empty table gives an empty result.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(own, lambda df: with_picks(df, "text", "picks", gram, window))
    n = F.char_length("text").cast("bigint")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n.cast("int") - cut), F.substring("next.text", F.lit(1), cut)))
    rows = with_picks(rows, "edited", "edited_picks", gram, window)
    return rows.select(
        "doc_id",
        n.alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("picks")).alias("fingerprint"),
        digest(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(F.col("picks"), F.col("edited_picks")).alias("near_edited"),
        likeness(F.col("picks"), F.col("next.picks")).alias("near_next"),
    )
