"""Substring dedup by seed and extend over winnowed anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import keep

#: Words in a repeat, and in an anchor. Each window of SPAN words has one anchor of GRAM words.
SPAN, GRAM = 50, 20
#: Kinds of surroundings of an anchor that meet a copy of its leader.
SHARE = 10_000
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """XXH64 of words; emptied when it grows large, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


def _rolling(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every run of ``n`` codes, from hashes of runs of powers of two."""
    with np.errstate(over="ignore"):
        block, size, out, done = codes, 1, None, 0
        while True:
            if n & size:
                if out is None:
                    out, done = block, size
                else:
                    m = len(codes) - done - size + 1
                    out = out[:m] * _U(pow(base, size, 1 << 64)) + block[done : done + m]
                    done += size
            if size * 2 > n:
                return _mixed(out[: len(codes) - n + 1])
            block = block[:-size] * _U(pow(base, size, 1 << 64)) + block[size:]
            size *= 2


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    size, least = 1, x
    while size * 2 <= n:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = len(x) - n + 1
    return np.minimum(least[:m], least[n - size : n - size + m])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _anchors(codes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Anchors of a text of at least ``span`` words: hash, position, first and last window that has it.

    A window's anchor is its gram of the smallest hash, of equal ones the rightmost.
    It depends on the window's words alone, so equal windows have equal anchors at
    the same place within them.
    """
    if len(codes) < span:
        return None
    grams = _rolling(codes, gram, _BASES[0])
    order = (grams & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(grams), dtype=_U))
    place = (_U(0xFFFFFFFF) - (_sliding_least(order, span - gram + 1) & _U(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return grams[place[first]], place[first], first, last


def _context(windows: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of an anchor's surroundings: its two outermost windows, which together cover them, and their places."""
    with np.errstate(over="ignore"):
        reach = (place - first).astype(_U) * _U(1 << 20) + (last - first).astype(_U)
        return _mixed(windows[first] * _U(_BASES[0]) + windows[last] * _U(_BASES[1]) + reach)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


_KEYS = ["doc_id", "text_hash"]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, tuple]]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


class _Rows:
    """Collects columns and gives them out as batches of a bounded size."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.parts, self.n = names, [[] for _ in names], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, c in zip(self.parts, columns, strict=True):
            part.append(c)
        self.n += len(columns[0])
        if self.n >= 100_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(p)) for p in self.parts], names=self.names)
            self.parts, self.n = [[] for _ in self.names], 0


def _codes(words: list[bytes], hashes: _WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), dtype=_U, count=len(words))


def _find_anchors(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = _WordHashes(), _Rows(["anchor", "context", "doc_id", "text_hash", "first", "last", "place"])
        for doc_id, text in _each(batches):
            words = _words(text)
            if len(words) < span:
                continue
            codes = _codes(words, hashes)
            anchor, place, first, last = _anchors(codes, span, gram)
            context = _context(_rolling(codes, span, _BASES[1]), first, last, place)
            own = np.full(len(anchor), doc_id, dtype=np.int64)
            text_hash = np.full(len(anchor), xxhash.xxh64_intdigest(text), dtype=_U)
            yield from rows.add(anchor, context, own, text_hash, first, last, place)
        yield from rows.flush()

    return run


def _find_surroundings(span: int, gram: int):
    """For documents with open anchors: the words around each, as hashes, up to the ends of its outermost windows.

    ``around`` has one code for the anchor itself, at ``place - first``, so a window is
    a run of ``span - gram + 1`` codes.
    """
    kind = pa.schema([("anchor", pa.int64()), ("lead", pa.bool_()), ("kinds", pa.int64()), *[(c, pa.int64()) for c in ("doc_id", "text_hash", "first", "last", "place")], ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out, held = _WordHashes(), [], 0
        for doc_id, text, text_hash, seeds in _each(batches):
            codes = _codes(_words(text), hashes)
            for r in seeds:
                first, last, place = r["first"], r["last"], r["place"]
                around = np.concatenate([codes[first:place], np.array([r["anchor"]]).view(_U), codes[place + gram : last + span]])
                out.append((r["anchor"], r["lead"], r["kinds"], doc_id, text_hash, first, last, place, around.tobytes()))
                held += around.nbytes
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return run


def _extend(span: int, gram: int):
    """Extend each anchor's match with its leader both ways, word by word, to where it ends.

    Gives a row for the windows of a match that reaches over ``span`` words (``h1`` null)
    and a row with two hashes for each window outside of it, which the leader does not have.
    """
    side = span - gram
    kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), *[(c, pa.int64()) for c in ("doc_id", "text_hash", "first", "last", "low")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches, singles = [], _Rows(["h1", "h2", "doc_id", "text_hash", "first", "last", "low"])
            for doc_id, text_hash, first, last, place, around, low, at, other in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, its = np.frombuffer(around, dtype=_U), np.frombuffer(other, dtype=_U)
                left = _common(own[: place - first][::-1], its[:at][::-1])
                right = _common(own[place - first + 1 :], its[at + 1 :])
                begin, end = max(first, place - left), min(last, place + right - side)
                if begin <= end:
                    matches.append((None, None, doc_id, text_hash, begin, end, low))
                else:
                    begin, end = last + 1, last
                rest = np.concatenate([np.arange(first, begin), np.arange(end + 1, last + 1)])
                if len(rest):
                    one, two = _rolling(own, side + 1, _BASES[0])[rest - first], _rolling(own, side + 1, _BASES[1])[rest - first]
                    ids, texts = np.full(len(rest), doc_id, dtype=np.int64), np.full(len(rest), text_hash, dtype=np.int64)
                    yield from (b.cast(kind) for b in singles.add(one, two, ids, texts, rest, rest, ids))
            yield from (b.cast(kind) for b in singles.flush())
            if matches:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*matches, strict=True), kind, strict=True)], schema=kind)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _cut(span: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text, ranges in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = _words(text)
                n = len(words)
                if ranges:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, [r["first"] for r in ranges], 1)
                    np.add.at(edge, [r["last"] + span for r in ranges], -1)
                    words = [w for w, covers in zip(words, np.cumsum(edge[:n]).tolist(), strict=True) if not covers]
                kept = b" ".join(words)
                for column, x in zip(out, (doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"])

    return run


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Ranges of windows that also start in a document with a smaller id.

    Returns ``doc_id``, ``text_hash``, ``first``, ``last``: the windows of ``span`` words
    from word ``first`` to word ``last``; ranges of a document may touch. Words
    ``first`` to ``last + span - 1`` are a repeat over the length threshold.

    Seed: every window has an anchor, a winnowed gram of words; documents meet on
    equal anchors, and anchors of one document only are dropped. If an anchor's
    surroundings are the same, to both ends of its windows, as in a smaller document, all of
    them are repeats; one row per anchor decides that, and copies by the thousand
    stay in proportion. Extend: where surroundings differ, one document for each kind of them
    is held against the anchor's leader, its kind with the smallest document.
    The match is extended both ways, word by word, and kept where it is maximal and reaches ``span`` words;
    a longer one goes on at the next anchor. That is one pair for each kind, not all pairs of kinds.
    Windows outside of the match are not in the leader; kinds that share such windows
    find each other by hashes of them (128 bits), which is exact for the rest.
    """
    if not 0 < gram <= span:
        raise ValueError("an anchor fits into a window")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seeds = keep(rows.mapInArrow(_find_anchors(span, gram), "anchor bigint, context bigint, doc_id bigint, text_hash bigint, first bigint, last bigint, place bigint"), "anchors")
    kinds = seeds.groupBy("anchor", "context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = kinds.groupBy("anchor").agg(F.min(F.struct("low", "context")).alias("leader"), F.max("high").alias("most"), F.count("*").alias("kinds")).where("leader.low < most")
    met = kinds.join(shared.select("anchor", "kinds", F.col("leader.context").alias("leader")), "anchor").where("kinds > 1 or low < high")
    met = keep(met.select("anchor", "context", "low", "kinds", (F.col("context") == F.col("leader")).alias("lead")), "met-anchors")
    found = keep(seeds.join(met, ["anchor", "context"]).select(*_KEYS, "anchor", "first", "last", "place", "low", "kinds", "lead"), "seeds-met")
    whole = found.where("doc_id > low").select(*_KEYS, "first", "last")
    partly = found.where("doc_id = low and kinds > 1").groupBy(*_KEYS).agg(F.collect_list(F.struct("anchor", "lead", "kinds", "first", "last", "place")).alias("seeds"))
    open_docs = rows.join(partly, "doc_id").select("doc_id", "text", "text_hash", "seeds")
    kind = "anchor bigint, lead boolean, kinds bigint, doc_id bigint, text_hash bigint, first bigint, last bigint, place bigint, around binary"
    around = keep(open_docs.mapInArrow(_own_text(_find_surroundings(span, gram)), kind), "surroundings")
    # an anchor of many kinds meets its leader in as many shares as they fill
    shares = F.ceil(F.col("kinds") / SHARE)
    leaders = around.where("lead").groupBy("anchor").agg(F.min(F.struct("doc_id", "around", "first", "place")).alias("l"), F.max("kinds").alias("kinds"))
    leaders = leaders.select("anchor", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share"), F.col("l.doc_id").alias("low"), (F.col("l.place") - F.col("l.first")).alias("at"), F.col("l.around").alias("other"))
    others = around.where("not lead").withColumn("share", F.pmod(F.xxhash64("doc_id", "first"), shares))
    pairs = others.join(leaders, ["anchor", "share"]).select(*_KEYS, "first", "last", "place", "around", "low", "at", "other")
    extended = keep(pairs.mapInArrow(_extend(span, gram), "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, first bigint, last bigint, low bigint"), "extended")
    matches = extended.where("h1 is null and low < doc_id").select(*_KEYS, "first", "last")
    windows = extended.where("h1 is not null").drop("low")
    lows = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    single = windows.join(lows, ["h1", "h2"]).where("doc_id > low").select(*_KEYS, "first", "last")
    return whole.unionByName(matches).unionByName(single)


def _own_text(inner):
    """Leave out rows whose ranges belong to another text of the same id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, marks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                fits = [np.array(xxhash.xxh64_intdigest(t or ""), dtype=_U).view(np.int64) == h for t, h in zip(texts, marks, strict=True)]
                yield batch.filter(pa.array([bool(x) for x in fits]))

        yield from inner(own())

    return run


def cut_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Every document without the words of repeats: ``doc_id``, ``n_words``, ``n_removed``, ``text`` (kept words joined by one space;
    with ``digest`` their SHA-256 as ``kept_sha256`` in its place).

    A word goes if some window of ``span`` words over it also starts in a document
    with a smaller doc_id. Windows are those of the input, whatever is removed.
    One row per row of ``docs``; other columns are not read.

    Null and empty texts have no words. Rows of a null doc_id are kept whole and
    are no source of repeats. Rows of the same doc_id are no source for each
    other. An empty table gives an empty result.
    """
    found = repeats(docs, span, gram).groupBy(*_KEYS).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    per_id = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("text_hash", "ranges"))).alias("by_text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(per_id, "doc_id", "left").select("doc_id", "text", "by_text")
    return joined.mapInArrow(_chosen(_cut(span, digest)), f"doc_id bigint, n_words bigint, n_removed bigint, {'kept_sha256' if digest else 'text'} string")


def _chosen(inner):
    """Give each row the ranges of its own text."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                picked = []
                for text, by_text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    own_hash = int(np.array(xxhash.xxh64_intdigest(text or ""), dtype=_U).view(np.int64)) if by_text else 0
                    picked.append(dict(by_text).get(own_hash) if by_text else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(picked, kind)], names=["doc_id", "text", "ranges"])

        yield from inner(own())

    return run
