"""SimHash fingerprints and near-duplicate groups found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.tables import keep, without

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def simhash(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a text, as a signed integer.

    A-Z are lower-cased; words are what ASCII white space separates; shingles of
    ``words`` words, repeats included, are joined by one space (fewer words: the
    whole sequence). A bit is 1 if it is set in over half of the shingles' XXH64.
    No words, or a null text: 0.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[words - 1 :].tolist() if len(found) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(last), BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], last[at : at + BLOCK], strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(last)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (bigint) of each row of ``docs``; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


#: Candidates for verified links: fingerprints of classes into which words fall by hash, and of the sides of anchor shingles.
CLASSES, CLASS_LEAST, ANCHORS = 3, 4, 6
#: Words in the side of an anchor, at least: fewer are often equal by chance.
SIDE_LEAST = 8
FAMILIES = CLASSES + 2 * ANCHORS
#: Bits of the sketch of five-word shingles, and differing ones up to which two texts are candidates; at a similarity of 0.8, 39 are expected, 6 the deviation.
SKETCH_WORDS, SKETCH_BITS, SKETCH_DIFFERING = 5, 256, 60
#: Shingles of candidates that one task compares at once.
BLOCK_SHINGLES = 1 << 21


def _counts(digests: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of bytes of ``digests``."""
    counts = np.zeros(digests.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(digests), BLOCK):
        counts += np.unpackbits(digests[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return counts


def _majority(counts: np.ndarray, n: int) -> list[int]:
    return np.packbits(counts * 2 > n).view(">i8").tolist()


def _word_codes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in found]), dtype=">u8").astype(np.uint64)


def _mixed(x: np.ndarray, turn: int = 0) -> np.ndarray:
    """One of several independent mixes of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of each five-word shingle, rolled from the words' hashes (fewer words: the whole sequence); no words: a zero."""
    if not len(codes):
        return np.zeros(1, dtype=np.uint64)
    width = min(SKETCH_WORDS, len(codes))
    out = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9FB21C651E98DF25) + codes[k : k + len(out)]
    return _mixed(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct five-word shingles (fewer words: the whole sequence); no words: a zero."""
    return np.unique(_shingles(_word_codes(text)).view(np.int64))


def set_hash(shingles: np.ndarray) -> list[int]:
    """128 bits of hash of a set of shingles, as two signed integers."""
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=">i8").tolist()


def _bytes(codes: np.ndarray) -> np.ndarray:
    return codes.astype(">u8").view(np.uint8).reshape(-1, 8)


def sketch(text: str | None) -> list[int | None]:
    """``FAMILIES`` fingerprints of a text's words, its SimHash of ``SKETCH_BITS`` bits over distinct five-word shingles and the ``set_hash`` of these.

    Distinct words fall into classes by hash; each class has a SimHash, of which
    scattered edits leave some almost as it was. A word counts once, so the frequent
    words of a language do not make long texts alike. A block that is added or cut
    changes all classes, but one side of an anchor (a shingle that is the least by one
    of its hashes) stays the same: the words before, or from the anchor on, whose
    distinct ones are hashed. A side of less than a third of the words, or under
    ``SIDE_LEAST``, has no fingerprint. These find candidates, of which
    the sketch leaves those whose shingles may be alike. For a similarity (Jaccard) of
    0.8, the chance that one of its bits differs is 0.15.
    """
    codes = _word_codes(text)
    n = len(codes)
    distinct, at = np.unique(_shingles(codes).view(np.int64), return_index=True)
    whole_set = set_hash(distinct)
    if not n:
        return [0] * CLASSES + [None] * (2 * ANCHORS) + [0] * (SKETCH_BITS // 64) + whole_set
    mixes = [_mixed(distinct.view(np.uint64), k) for k in range(max(ANCHORS, SKETCH_BITS // 64))]
    words = np.unique(codes)
    kind = (_mixed(words) % np.uint64(CLASSES)).astype(np.int64)
    out: list[int | None] = []
    for c in range(CLASSES):
        own = words[kind == c] if (kind == c).sum() >= CLASS_LEAST else words
        out += _majority(_counts(_bytes(own)), len(own))
    anchors = [int(at[w.argmin()]) for w in mixes[:ANCHORS]]
    for p in anchors:
        for side in (codes[:p], codes[p:]):
            out += set_hash(np.unique(side))[:1] if len(side) >= max(n / 3, SIDE_LEAST) else [None]
    for w in mixes[: SKETCH_BITS // 64]:
        out += _majority(_counts(_bytes(w)), len(w))
    return out + whole_set


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``f0`` and so on (the fingerprints), ``s0`` to ``s3``, ``h0`` and ``h1`` (of the set of shingles) of each row of ``docs``."""
    names = [*[f"f{i}" for i in range(FAMILIES)], *[f"s{i}" for i in range(SKETCH_BITS // 64)], "h0", "h1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in found], pa.int64()) for i in range(len(names))]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))


def covering_masks(radius: int) -> list[int]:
    """Bit masks, as signed integers, such that any two fingerprints within ``radius`` agree under one of them.

    Bit i gets a nonzero vector of ``radius + 1`` bits. The mask of a nonzero v
    keeps the bits whose vector has an odd product with v. Any ``radius`` vectors
    leave some v to which all are orthogonal; its mask keeps none of those bits.
    """
    n = (1 << radius + 1) - 1
    masks = [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def _differing(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits; the count of a signed integer would be that of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fp: np.ndarray, node: np.ndarray, radius: int, out: list[tuple[np.ndarray, np.ndarray]], wide: list[np.ndarray], earlier: np.ndarray) -> None:
    """Links of a forest whose trees are the linked sets of one bucket; not those of pairs that agree under one of the ``earlier`` masks.

    A pair that agrees under an earlier mask is linked, by itself or through others, in
    that mask's bucket. ``wide``: parts of sketches, to differ in ``SKETCH_DIFFERING`` bits at most.
    """
    left = np.arange(len(fp))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            apart = fp[left] ^ fp[i]
            near = _differing(apart, np.int64(0)) <= radius
            if wide:
                near &= sum(_differing(s[left], s[i]).astype(np.int64) for s in wide) <= SKETCH_DIFFERING
            found, new = left[near], apart[near]
            if len(found):
                first = found[_is_new(new, earlier)]
                out.append((node[first], np.full(len(first), node[i])))
                todo += found.tolist()
                left = left[~near]


def _is_new(apart: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Pairs, by their differing bits, that agree under none of the ``earlier`` masks."""
    new = np.ones(len(apart), dtype=bool)
    for m in earlier:
        new &= (apart & m) != 0
    return new


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, dense: int, earlier: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by table and key. Yields links (kind 0) and the members of dense buckets (kind 1 + table: fp and node, or if there are sketches key, node, fp and sketch).

    ``earlier`` has the masks of the tables before each table, of the same fingerprints. A dense
    bucket leaves all its pairs to the caller, and so do the others those that agree in it.
    """
    held: list[np.ndarray] | None = None
    overflow = False  # the bucket that is held is dense, and its first members are out
    none = np.empty(0, dtype=np.int64)

    def rows(kind: int, a: np.ndarray, b: np.ndarray, more: list[np.ndarray], n_more: int) -> pa.RecordBatch:
        own = [pa.array(x, pa.int64()) for x in (a, b, *more)] + [pa.nulls(len(a), pa.int64())] * (n_more - len(more))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), *own], names=["kind", "a", "b", *["fp", *[f"s{i}" for i in range(n_more - 1)]][:n_more]])

    def members(t: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray, *wide: np.ndarray) -> pa.RecordBatch:
        return rows(1 + int(t[0]), key, node, [fp, *wide], 1 + len(wide)) if wide else rows(1 + int(t[0]), fp, node, [], 0)

    def closed(t: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray, *wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, sizes = np.concatenate([[0], new]), np.diff(np.concatenate([[0], new, [len(t)]]))
        links: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
        two = starts[sizes == 2]
        near = two[_differing(fp[two], fp[two + 1]) <= radius]
        if wide:
            near = near[sum(_differing(s[near], s[near + 1]).astype(np.int64) for s in wide) <= SKETCH_DIFFERING]
        for table in np.unique(t[near]).tolist() if earlier else ():
            own = t[near] == table
            near = near[~own | _is_new(fp[near] ^ fp[near + 1], earlier[table])]
        links.append((node[near], node[near + 1]))
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            part = [c[at : at + n] for c in (t, key, fp, node, *wide)]
            if n <= dense:
                _forest(part[2], part[3], radius, links, part[4:], earlier[int(part[0][0])] if earlier else none)
            else:
                yield members(*part)
        yield rows(0, np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), [], 1 + len(wide) if wide else 0)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        t, key, fp, node = cols[:4]
        if not len(t):
            continue
        cut = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0] != t[-1] or key[0] != key[-1]) else 0
        if overflow:
            end = int(np.flatnonzero((t != t[0]) | (key != key[0]))[0]) if cut else len(t)
            yield members(*[c[:end] for c in cols])
            if not cut:
                held = [c[-1:] for c in cols]  # the bucket may go on
                continue
            cols = [c[end:] for c in cols]
            cut, overflow = cut - end, False
        yield from closed(*[c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
        if len(held[0]) > dense:
            yield members(*held)
            held, overflow = [c[-1:] for c in held], True
    if overflow:
        yield members(*held)
    elif held is not None:
        yield from closed(*held)


def _midpoint_links(members: DataFrame, radius: int) -> DataFrame:
    """Links among the members of dense buckets, through fingerprints halfway between them.

    Two fingerprints are within ``radius`` (even) exactly if some fingerprint is
    within half of it from both. All that share such a midpoint are links of its
    smallest node, so the work is in proportion to the members.
    """
    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(BITS)} | set(flips))
    signed = ",".join(str(f - (1 << BITS) if f >> BITS - 1 else f) for f in flips)
    points = members.select("node", F.explode(F.transform(F.split(F.lit(signed), ",").cast("array<bigint>"), lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    low = points.groupBy("mid").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("mid", "b")
    return points.join(low, "mid").where("node <> b").select(F.col("node").alias("a"), "b")


#: Shares into which each dense bucket is dealt to meet its leader.
SALTS = 64


def _leader_links(members: DataFrame, wide: list[str], radius: int, dense: int) -> DataFrame:
    """Links among the members (``t``, ``key``, ``node``, ``fp``, ``wide``) of dense buckets that need like sketches.

    Every member meets the leader of its bucket, the smallest node; near copies of
    one text are mostly done with that. The rest is a query set against the whole
    bucket, in blocks: block i of the rest meets block j of all members in one
    task, about ``2 * dense`` rows, which yields a star for each linked set.
    """
    bucket = ["t", "key"]
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    leaders = members.groupBy(*bucket).agg(F.min(F.struct("node", "fp", *wide)).alias("lead"), F.count("*").alias("n"))
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead.{c}"))) for c in wide), F.lit(0))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= radius) & (apart <= SKETCH_DIFFERING)
    met = keep(salted.join(leaders, [*bucket, "salt"]).select(*bucket, "node", "fp", *wide, "n", F.col("lead.node").alias("leader"), near.alias("near")), "met-leaders")
    rest = met.where("not near")
    blocks = rest.groupBy(*bucket).agg(F.ceil(F.count("*") / dense).alias("rest_blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))

    def dealt(df: DataFrame, own: str, others: str) -> DataFrame:
        """Each row in a block of its own side, once for each block of the other side."""
        sized = df.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(blocks, [*bucket, "salt"]).withColumn("all_blocks", F.ceil(F.col("n") / dense))
        mine, other = {"i": ("rest_blocks", "all_blocks"), "j": ("all_blocks", "rest_blocks")}[own]
        place = F.pmod(F.xxhash64("node", F.lit(own)), F.col(mine)).alias(own)
        return sized.select(*bucket, place, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(others), "node", "fp", *wide)

    cells = dealt(rest, "i", "j").unionByName(dealt(met, "j", "i"))

    def compare(cell: pa.Table) -> pa.Table:
        rows = np.unique(np.stack([cell.column(c).to_numpy() for c in ("fp", "node", *wide)]), axis=1)
        links: list[tuple[np.ndarray, np.ndarray]] = [(np.array([], dtype=np.int64),) * 2]
        _forest(rows[0], rows[1], radius, links, list(rows[2:]), np.empty(0, dtype=np.int64))
        return pa.table({"a": np.concatenate([x for x, _ in links]), "b": np.concatenate([y for _, y in links])})

    across = cells.groupBy(*bucket, "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return met.where("near").select(F.col("node").alias("a"), F.col("leader").alias("b")).unionByName(across)


def fingerprint_links(fps: DataFrame, radius: int = 4, dense: int = 4096) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs within ``radius`` differing bits.

    ``fps`` has distinct ``fp`` with a ``node`` each. For every covering mask the
    fingerprints meet in the bucket of their masked bits. A bucket of up to
    ``dense`` members is compared within the task that streams over it, and only
    a star for each linked set comes out, never all pairs. Larger buckets are left
    to the midpoints, which are exact as well. ``radius`` is even.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    found = _met(fps.where("node is not null").select("node", F.col("fp"), F.explode(_tables(F.col("fp"), radius)).alias("x")), [], radius, dense, _earlier(radius))
    members = found.where("kind > 0").select(F.col("a").alias("fp"), F.col("b").alias("node")).distinct()
    return found.where("kind = 0").select("a", "b").unionByName(_midpoint_links(members, radius)).distinct()


def _tables(fp: Column, radius: int, first: int = 0) -> Column:
    """A struct of table number, key and fingerprint for each covering mask; one for equal fingerprints if the radius is zero."""
    return F.array(*[F.struct(F.lit(first + t).cast("bigint").alias("t"), fp.bitwiseAND(F.lit(m)).alias("key"), fp.alias("fp")) for t, m in enumerate(covering_masks(radius) if radius else [-1])])


def _earlier(radius: int) -> list[np.ndarray]:
    """For each covering mask, the masks before it."""
    masks = np.array(covering_masks(radius) if radius else [-1], dtype=np.int64)
    return [masks[:i] for i in range(len(masks))]


def _met(keyed: DataFrame, wide: list[str], radius: int, dense: int, earlier: list[np.ndarray]) -> DataFrame:
    rows = keyed.select("x.t", "x.key", "x.fp", "node", *wide)
    schema = "kind int, a bigint, b bigint" + "".join(f", {c} bigint" for c in (["fp", *wide] if wide else []))
    found = rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda it: _bucket_links(it, radius, dense, earlier), schema)
    return keep(found, "bucket-links")


def sketch_links(classes: DataFrame, radius: int = 4, dense: int = 4096) -> DataFrame:
    """Links ``a``, ``b`` between nodes with like sketches of which some fingerprint is alike too.

    ``classes`` has ``node``, the fingerprints ``f0`` and so on, of which a null is like
    none, and parts of sketches ``s0`` and so on. The first ``CLASSES`` fingerprints are alike
    within ``radius`` bits, the others if equal. Members of a bucket of over ``dense``
    meet the bucket's leader, and those unlike it the whole bucket in blocks of
    ``dense``, with stars for linked sets.
    """
    fps, wide = ([c for c in classes.columns if c[0] == kind and c[1:].isdigit()] for kind in "fs")
    tables, earlier = [], []
    for i, fp in enumerate(fps):
        near = radius if i < CLASSES else 0
        tables.append(_tables(F.col(fp), near, len(earlier)))
        earlier += _earlier(near)
    keyed = classes.select("node", *wide, F.explode(F.filter(F.concat(*tables), lambda x: x["fp"].isNotNull())).alias("x"))
    found = _met(keyed, wide, radius, dense, earlier)
    links, hot = found.where("kind = 0").select("a", "b"), found.where("kind > 0")
    if hot.isEmpty():
        return links
    members = hot.select((F.col("kind") - 1).cast("bigint").alias("t"), F.col("a").alias("key"), F.col("b").alias("node"), "fp", *wide).distinct()
    return links.unionByName(_leader_links(keep(members, "dense-buckets"), wide, radius, dense)).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node`` (the doc_id) and ``shingles`` (see ``shingle_set``) of each row of ``docs``, with the hash of the set as in ``sketches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(1)]
            whole = np.array([set_hash(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole[:, 0]), pa.array(whole[:, 1]), lists], names=["node", "h0", "h1", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "node bigint, h0 bigint, h1 bigint, shingles array<bigint>")


def _common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Members that a sorted set has in common with each of ``many``."""
    values = np.concatenate(many)
    at = np.searchsorted(one, values)
    at[at == len(one)] = 0
    starts = np.concatenate([[0], np.cumsum([len(m) for m in many])[:-1]])
    return np.add.reduceat((one[at] == values).astype(np.int64), starts)


def _verified_forest(sets: list[np.ndarray], node: np.ndarray, wide: list[np.ndarray], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Links of each set of candidates that are linked by a Jaccard of 0.8 or more to its smallest node.

    Whoever is linked is compared with all that are not yet, so one that fails against
    one member meets the others.
    """
    sizes, left = np.array([len(s) for s in sets], dtype=np.int64), np.arange(len(sets))
    while len(left):
        group, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            fits = sum(_differing(s[left], s[i]).astype(np.int64) for s in wide) <= SKETCH_DIFFERING
            fits &= np.minimum(sizes[left], sizes[i]) * 5 >= np.maximum(sizes[left], sizes[i]) * 4
            some = left[fits]
            if not len(some):
                continue
            # the common ones are 0.8 of the union: 9 times them are 4 times both sizes
            near = some[_common(sets[i], [sets[k] for k in some]) * 9 >= 4 * (sizes[some] + sizes[i])]
            left = left[~np.isin(left, near)]
            todo += near.tolist()
            group += near.tolist()
        nodes = node[group]
        rest = nodes[nodes != nodes.min()]
        if len(rest):
            out.append((rest, np.full(len(rest), nodes.min())))


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(values, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def _link_table(links: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    none = np.empty(0, dtype=np.int64)
    return {"a": pa.array(np.concatenate([none, *[x for x, _ in links]])), "b": pa.array(np.concatenate([none, *[y for _, y in links]]))}


def _verify_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links among the rows of each ``component``, by which the rows are sorted."""
    held: list | None = None
    names = ["component", "node", *[f"s{i}" for i in range(SKETCH_BITS // 64)]]

    def linked(cols: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = [*(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), len(sets)]
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip([0, *ends], ends, strict=False):
            if b - a > 1:
                _verified_forest(sets[a:b], cols[1][a:b], [c[a:b] for c in cols[2:]], links)
        return pa.RecordBatch.from_pydict(_link_table(links))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols, sets = [batch.column(n).to_numpy(zero_copy_only=False) for n in names], _lists(batch.column("shingles"))
        if held is not None:
            cols, sets = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)], held[1] + sets
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield linked([c[:cut] for c in cols], sets[:cut])
        held = [[c[cut:] for c in cols], sets[cut:]]
    if held is not None:
        yield linked(*held)


def verified_links(candidates: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs of a component's candidates with a Jaccard of 0.8 or more.

    ``candidates`` has ``component``, ``node``, ``s0`` to ``s3`` and ``shingles``; pairs
    whose sketches differ in over ``SKETCH_DIFFERING`` bits count as not alike. A component of up to ``block``
    shingles is compared in one task. Members of a larger one meet its smallest node,
    and those unlike it the whole component in blocks of about as many shingles.
    """
    wide, size = [f"s{i}" for i in range(SKETCH_BITS // 64)], F.size("shingles").cast("bigint")
    large = keep(candidates.groupBy("component").agg(F.sum(size).alias("n")).where(F.col("n") > block), "large-candidates")
    small = candidates.join(large, "component", "left_anti").select("component", "node", *wide, "shingles")
    links = small.repartition("component").sortWithinPartitions("component").mapInArrow(_verify_sorted, "a bigint, b bigint")
    if large.isEmpty():
        return links
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    members = keep(candidates.join(large, "component").select("component", "node", *wide, "shingles", "n", salt.alias("salt")), "large-members")
    leaders = members.groupBy("component").agg(F.min(F.struct("node", *wide, "shingles")).alias("lead")).select("component", "lead", salts)
    both = F.size(F.array_intersect("shingles", F.col("lead.shingles"))).cast("bigint")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead.{c}"))) for c in wide), F.lit(0))
    near = (apart <= SKETCH_DIFFERING) & (both * 9 >= (size + F.size("lead.shingles")) * 4)
    met = keep(members.join(leaders, ["component", "salt"]).select("component", "node", *wide, "shingles", "n", "salt", F.col("lead.node").alias("leader"), near.alias("near")), "large-met")
    rest = met.where("not near")
    blocks = rest.groupBy("component").agg(F.ceil(F.sum(size) / block).alias("rest_blocks")).select("component", "rest_blocks", salts)

    def dealt(df: DataFrame, own: str, others: str, mine: str, other: str) -> DataFrame:
        """Each row in a block of its own side, once for each block of the other side."""
        sized = df.join(blocks, ["component", "salt"]).withColumn("all_blocks", F.ceil(F.col("n") / block))
        return sized.select("component", F.pmod(F.xxhash64("node", F.lit(own)), F.col(mine)).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(others), "node", *wide, "shingles")

    cells = dealt(rest, "i", "j", "rest_blocks", "all_blocks").unionByName(dealt(met, "j", "i", "all_blocks", "rest_blocks"))

    def compare(cell: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        _verified_forest(_lists(cell.column("shingles")), cell.column("node").to_numpy(), [cell.column(c).to_numpy() for c in wide], found)
        return pa.table(_link_table(found))

    across = cells.groupBy("component", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return links.unionByName(met.where("near").select(F.col("node").alias("a"), F.col("leader").alias("b"))).unionByName(across)


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, dense: int = 4096) -> DataFrame:
    """SimHash group of every document.

    Reads ``doc_id`` and ``text`` of ``docs``; other columns are ignored. Returns
    one row per row: ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest doc_id reachable over links of at most
    ``radius`` differing bits, itself included.

    Null and empty texts have no words: fingerprint zero, linked like any other.
    Rows with a null doc_id get the group of their fingerprint, null if no row
    of that fingerprint has an id. Repeated rows are returned as often as they occur.
    An empty table gives an empty result.
    """
    own = keep(fingerprints(docs, words), "simhash")
    fps = keep(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    groups = fps.join(components(fingerprint_links(fps, radius, dense)), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest id. All columns stay.

    Candidates agree in a SimHash of a class of their words (up to ``radius`` bits) or
    of a side of an anchor shingle, found by covering hashing, and have like
    sketches of five-word shingles. Of those that candidates connect, pairs whose sets of shingles
    have a Jaccard of 0.8 or more are linked, by the sets themselves (as 64-bit hashes).
    Groups are what links connect; equal sets are one from the start. Rows with a null id stay; null
    and empty texts are alike. Repeated rows of an id stay or go together. Of exact
    copies under one id, all rows stay.
    """
    own = keep(sketches(docs), "sketches")
    key, wide = ["h0", "h1"], [f"s{i}" for i in range(SKETCH_BITS // 64)]
    parts = [c for c in own.columns if c not in ("doc_id", *key)]
    # equal sets have equal sketches, but the fingerprints of their words can differ
    nodes = own.where("doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", *parts)).alias("x"))
    classes = keep(nodes.select(*key, F.col("x.doc_id").alias("node"), *[f"x.{p}" for p in parts]), "sketch-classes")
    found = keep(components(sketch_links(classes.drop(*key), radius)), "candidates")
    sets = shingle_sets(docs.select("doc_id", "text").join(found.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))
    candidates = keep(sets.join(classes.select("node", *key, *wide), ["node", *key]).join(found, "node"), "candidate-sets")
    groups = classes.join(components(verified_links(candidates)), "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    gone = own.join(groups, key).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, gone, "doc_id", "near-duplicates")
