"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import keep, without

#: Tokens in a window, and tokens of an item in a row that count as contamination (all of a shorter item).
WINDOW, RUN = 8, 13
#: Literal tokens that a window needs at least: placeholders alone say nothing.
LITERAL = 4
#: Bits of the filter that windows pass before they are shuffled; its size is fixed.
FILTER_BITS = 1 << 22
#: Units of measure after a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg lb lbs oz ml l ms s sec min h hr hrs hour hours day days week weeks month months year years minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent km/h mph kmh hz khz mhz kb mb gb tb usd eur gbp".split())

_U = np.uint64
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(%|[a-z]{0,4})")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_INNER = re.compile(r"[^\w%$€£]+")
#: Codes of the placeholders for numbers, names and units.
NUMBER, NAME, UNIT = (xxhash.xxh64_intdigest(x) for x in ("<number>", "<name>", "<unit>"))
_BASE = 0x9E3779B97F4A7C15
#: Flags of a chunk: it is a number, a unit, like a name, the last of a sentence; it has a token.
IS_NUMBER, IS_UNIT, IS_NAME, IS_LAST, IS_TOKEN = 1, 2, 4, 8, 16


class _Chunks(dict):
    """Code (upper bits) and flags (the five lowest) of chunks between white space; emptied when large, which changes no result."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > 100_000:
            self.clear()
        bare = chunk.rstrip(".,;:!?")
        plain = bare.isalpha()  # most chunks; the patterns would find the same
        if not plain:
            bare = _EDGE.sub("", chunk)
        word = bare.lower() if plain else _INNER.sub("", bare.lower())
        flags = IS_LAST if chunk[-1] in ".!?:" or chunk[-2:-1] in (".", "!", "?") else 0
        if word:
            flags |= IS_TOKEN
            if not plain and _NUMBER.fullmatch(bare.lower()):
                flags |= IS_NUMBER
            elif word in UNITS:
                flags |= IS_UNIT
            elif len(word) > 1 and bare[:1].isupper() and not bare[1:].isupper():
                flags |= IS_NAME
        self[chunk] = out = xxhash.xxh64_intdigest(word) & ~31 | flags
        return out


def _canonical(text: str | None, chunks: _Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Literal codes, template codes, which tokens are slots and which are if names can begin a sentence.

    Tokens are words without case and punctuation. In the template, numbers, names
    (capitalised words within a sentence) and units (after a number) are placeholders.
    """
    parts = (text or "").split()
    found = np.fromiter(map(chunks.__getitem__, parts), dtype=_U, count=len(parts))
    codes, flags = found & ~_U(31), (found & _U(31)).astype(np.int64)
    begins = np.concatenate([[True], (flags[:-1] & IS_LAST) > 0])[: len(flags)]
    token = (flags & IS_TOKEN) > 0
    codes, flags, begins = codes[token], flags[token], begins[token]
    number = (flags & IS_NUMBER) > 0
    after = np.concatenate([[False], number[:-1]])[: len(flags)]
    unit, capital = ((flags & IS_UNIT) > 0) & after, (flags & IS_NAME) > 0
    name = capital & ~begins
    template = np.where(number, _U(NUMBER), np.where(unit, _U(UNIT), np.where(name, _U(NAME), codes)))
    slot = number | unit | name
    return codes, template, slot, slot | capital


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - n + 1), dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _U(_BASE) + codes[k : k + len(out)]
        out = (out ^ (out >> _U(31))) * _U(0xFF51AFD7ED558CCD)
    return out ^ (out >> _U(32))


def _windows(text: str | None, chunks: _Chunks, width: int) -> tuple[np.ndarray, ...]:
    """Per window: hash, position and variant; then the codes, and which tokens are slots in variants 1 and 2.

    Literal windows (variant 0) all count; template windows (1) where they differ from them and
    have enough literal tokens. In variant 2 capitalised words that begin a sentence are
    names too; it has the windows that differ from the template.
    """
    codes, template, slot, wide = _canonical(text, chunks)
    plain = _rolling(codes, width)
    if not len(plain):
        empty = np.empty(0, dtype=np.int64)
        return plain, empty, empty, codes, slot, wide
    slots, wides = (np.concatenate([[0], np.cumsum(x)]) for x in (slot, wide))
    n_slots, n_wide = slots[width:] - slots[:-width], wides[width:] - wides[:-width]
    most = width - min(LITERAL, width)
    some = np.flatnonzero((n_slots > 0) & (n_slots <= most))
    more = np.flatnonzero((n_wide > n_slots) & (n_wide <= most))
    hashes = [plain, _rolling(template, width)[some]]
    if len(more):
        hashes.append(_rolling(np.where(wide & ~slot, _U(NAME), template), width)[more])
    at = np.concatenate([np.arange(len(plain)), some, more])
    return np.concatenate(hashes), at, np.repeat([0, 1, 2], [len(plain), len(some), len(more)]), codes, slot, wide


_SCHEMA = "hash bigint, id bigint, at bigint, variant int, slots array<bigint>, n_windows bigint, width int"


def _cut(text: str | None, chunks: _Chunks, width: int, short: list[int] | None) -> Iterator[tuple]:
    """Windows of ``width`` tokens and of the widths in ``short``, there without placeholders; ``short`` None: a text of fewer tokens is one window, if it has ``LITERAL``."""
    found = _windows(text, chunks, width)
    yield width, *found
    codes, n = found[3], len(found[3])
    if short is None:
        short = [n] if LITERAL <= n < width else []
    for w in short:
        hashes = _rolling(codes, w) ^ _U(w)
        yield w, hashes, np.arange(len(hashes)), np.zeros(len(hashes), dtype=np.int64), codes, found[4], found[5]


def _emit(width: int, filter_: np.ndarray | None, short: list[int] | None = None):
    """Windows of texts; with a filter those that pass it, and those of the widths in ``short`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks()
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], [], []]
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w, hashes, at, variant, codes, slot, wide in _cut(text.as_py(), chunks, width, short):
                    n = max(0, len(codes) - w + 1)
                    if filter_ is not None:
                        bit = (hashes % _U(FILTER_BITS)).astype(np.int64)
                        passed = np.flatnonzero(filter_[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                        hashes, at, variant = hashes[passed], at[passed], variant[passed]
                    if not len(hashes):
                        continue
                    signed = codes.view(np.int64)
                    slots = [signed[a : a + w][(slot, wide)[v - 1][a : a + w]].tolist() if v else None for a, v in zip(at.tolist(), variant.tolist(), strict=True)]
                    for column, x in zip(columns, (hashes.view(np.int64).tolist(), [id_] * len(at), at.tolist(), variant.tolist(), slots, [n] * len(at), [w] * len(at)), strict=True):
                        column += x
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hash", "id", "at", "variant", "slots", "n_windows", "width"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, run: int = RUN) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other numbers, names and units.

    Reads ``doc_id``, ``text`` and ``item_id``, ``text``. Returns one row for each pair that
    counts: ``doc_id``, ``item_id``, ``n_windows`` (windows that match), ``share`` (of the
    item's windows) and ``kind`` (``verbatim`` or ``template``).

    Both sides are cut into windows of ``width`` tokens, as they are and with
    placeholders; equal windows meet in a hash join. Matches of a pair are kept
    along one shift between the two texts. A pair counts if they span ``run`` tokens,
    or all of a shorter item. Template windows count only while slots are
    consistent: each value of the item stands for one value in the document. Capitalised
    words that begin a sentence are read both ways, as they are and as names; the second way falls
    by itself if its slots are inconsistent.

    Items of fewer than ``width`` tokens match where they stand whole, verbatim; those
    of fewer than ``LITERAL`` are in any text, so like null texts and rows with a null id
    they match nothing. Repeated rows of an id count as one document or item, an empty table
    gives an empty result. What is broadcast is a filter of ``FILTER_BITS`` bits,
    whatever the benchmark's size; windows that pass it by chance end in the join.
    """
    select = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    items = keep(select(benchmark, "item_id").mapInArrow(_emit(width, None), _SCHEMA), "item-windows")
    bits = items.select(F.pmod(F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)"), F.lit(FILTER_BITS)).cast("int").alias("bit")).select((F.col("bit") / 8).cast("int").alias("byte"), F.expr("shiftleft(1, bit % 8)").alias("b"))
    filter_ = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in bits.groupBy("byte").agg(F.bit_or("b").alias("b")).collect():
        filter_[r["byte"]] = r["b"]
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    short = sorted(r["width"] for r in items.where(F.col("width") < width).select("width").distinct().collect())
    found = select(docs, "doc_id").mapInArrow(lambda it: _emit(width, shared.value, short)(it), _SCHEMA)
    template = (F.col("variant") > 0).alias("template")
    own = items.select("hash", "width", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("variant").alias("item_variant"), template, F.col("n_windows").alias("of")).distinct()
    met = found.select("hash", "width", F.col("id").alias("doc_id"), "at", "slots", "variant", template).distinct().join(own, ["hash", "width", "template"])
    # a name can begin a sentence on one side only: equal windows meet whatever their variants
    met = keep(met.withColumn("variant", F.greatest("variant", "item_variant")).withColumn("shift", F.col("at") - F.col("item_at")), "matches")
    pair = ["doc_id", "item_id", "shift"]
    # a value of the item that stands for several values in the document makes the pair's template windows void
    values = met.where("template").select(*pair, "variant", F.explode(F.arrays_zip("item_slots", "slots")).alias("v"))
    first = F.when(F.col("variant") == 1, F.col("v.slots"))
    torn = values.groupBy(*pair, "v.item_slots").agg((F.min(first) != F.max(first)).alias("torn"), (F.min("v.slots") != F.max("v.slots")).alias("torn_wide"))
    torn = torn.where("torn_wide").groupBy(*pair).agg(F.coalesce(F.max("torn"), F.lit(False)).alias("void"), F.lit(True).alias("void_wide"))
    kept = met.join(torn, pair, "left").where("variant = 0 or void_wide is null or variant = 1 and not void")
    spans = kept.groupBy(*pair).agg(F.countDistinct("at").alias("n_windows"), F.max("of").alias("of"), F.countDistinct(F.when(F.col("variant") == 0, F.col("at"))).alias("plain"))
    enough = spans.where((F.col("n_windows") >= F.least(F.lit(max(1, run - width + 1)), F.col("of"))))
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "plain", "of")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", (F.col("b.n_windows") / F.col("b.of")).alias("share"), F.when(F.col("b.plain") == F.col("b.n_windows"), "verbatim").otherwise("template").alias("kind"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, run: int = RUN) -> DataFrame:
    """``docs`` without documents that hold a benchmark item; all columns stay, and so do rows with a null id."""
    return without(docs, contaminated(docs, benchmark, width, run).select("doc_id").distinct(), "doc_id", "contaminated")
