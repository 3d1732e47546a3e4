"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import keep

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Gap between the fractional solution and its bound at which multiplicative weights stop; most passes and rounds of a pass.
GAP, PASSES, ROUNDS = 1e-4, 8, 60
#: How far the price of a length follows what is left of its need within a pass, and its cost from pass to pass; the share of what is left that a round covers.
LAG, COST, SHARE = 0.3, 0.5, 0.5
#: Rows of one length that are numbered by one task.
LANE = 1_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder:
    """Ids of a byte-level BPE vocabulary file, as the ``tokenizers`` library gives them without special tokens of its own.

    Texts go through ``tiktoken``, built from the same vocabulary as ranks, which gives
    the same ids several times as fast where every merge's rank is its result's id.
    Texts that hold the string of an added token, and all texts where there are no
    ranks, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f))
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        except (ImportError, FileNotFoundError):
            pass

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: all of full length but for the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.append(encode(text.as_py() or ""), np.array([END], dtype="<u4"))
                for piece, (start, length) in enumerate(cut(len(whole), capacity)):
                    part = whole[start : start + length]
                    for column, x in zip(out, (doc_id, piece, start, length, zlib.crc32(part.tobytes()), part.tolist() if ids else None), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def _knapsack(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest total worth of lengths (indices of ``worth``, any number of each) within every capacity, and the length taken last (0: none); of equal ones the longest."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(worth > 0)[::-1]
    own = worth[lengths]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = int(np.searchsorted(-lengths, -c))
        if fits < len(lengths):
            gains = best[c - lengths[fits:]] + own[fits:]
            at = int(gains.argmax())
            if gains[at] > best[c] + 1e-12:
                best[c], took[c] = gains[at], lengths[fits + at]
    return best, took


def _pattern(length: int, took: np.ndarray, capacity: int) -> dict[int, int]:
    """``length`` and the knapsack's choice for the rest of the capacity."""
    out, c = {length: 1}, capacity - length
    while c > 0:
        k = int(took[c])
        if k:
            out[k] = out.get(k, 0) + 1
        c -= k or 1
    return out


def _cover(counts: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[dict[tuple, float], np.ndarray, float]:
    """One pass over the needs: patterns and how much of each, what is left, and a lower bound of the program.

    Each round prices the lengths, multiplicatively by their weight and by how far their
    cover lags behind, fills a knapsack table, and for each length (the longest first)
    uses the best pattern that holds it, never beyond what is left.
    """
    need, left = np.maximum(counts, 1).astype(float), counts.astype(float)
    used: dict[tuple, float] = {}
    bound = 0.0
    for _ in range(ROUNDS):
        open_ = left > 1e-6 * need
        if not open_.any():
            break
        lag = left / need
        price = np.where(open_, np.arange(capacity + 1) / capacity * weight * np.exp(LAG * (lag - lag[open_].mean())), 0.0)
        best, took = _knapsack(price, capacity)
        # no pattern is worth more than the knapsack: prices over its worth are a solution of the dual
        bound = max(bound, float((counts * price).sum() / best[capacity]))
        wanted = np.where(left > 1, left * SHARE, left)
        for length in np.flatnonzero(open_)[::-1].tolist():
            pattern = _pattern(length, took, capacity)
            x = min([float(wanted[length]) / pattern[length], *(float(left[k]) / n for k, n in pattern.items())])
            if x > 0:
                key = tuple(sorted(pattern.items(), reverse=True))
                used[key] = used.get(key, 0.0) + x
                for k, n in pattern.items():
                    left[k] -= x * n
        left[left < 1e-9] = 0.0
    return used, left, bound


def configurations(counts: np.ndarray, capacity: int, gap: float = GAP, passes: int = PASSES) -> tuple[dict[tuple, float], float, float]:
    """Fractional solution of the configuration program: patterns ((length, times), longest first) and how many sequences use each; its value; a lower bound.

    The program covers ``counts[l]`` pieces of each length l by the fewest sequences.
    From pass to pass the weight of a length grows with what its tokens cost in the
    last solution, a power of the sequences' tokens over those that are filled. It
    stops when the best solution is within ``gap`` of the bound by the dual.
    """
    tokens, weight = np.arange(capacity + 1), np.ones(capacity + 1)
    best: tuple[dict[tuple, float], float] | None = None
    bound = 0.0
    for _ in range(passes):
        used, left, low = _cover(counts, weight, capacity)
        bound, value = max(bound, low), sum(used.values()) + float((left * tokens).sum()) / capacity
        if best is None or value < best[1]:
            best = used, value
        if best[1] <= bound * (1 + gap):
            break
        cost = np.zeros(capacity + 1)
        for pattern, x in used.items():
            filled = sum(k * n for k, n in pattern)
            for k, n in pattern:
                cost[k] += x * n * capacity / filled
        weight *= np.where(cost > 0, cost / np.maximum(counts - left, 1e-9), 1.0) ** COST
        weight /= weight.max()
    return *best, bound


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, of ``left[l]`` pieces of each length: patterns and how often. Equal sequences are handled together."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            free = min((f for f, g in groups.items() if f >= length and g), default=None)
            if free is None:
                each = capacity // length
                for k, times in ((each, n // each), (n % each, 1)):
                    if k and times:
                        groups.setdefault(capacity - k * length, []).append(([length] * k, times))
                n = 0
                continue
            pattern, count = groups[free].pop()
            m = min(n, count)
            if count > m:
                groups[free].append((pattern, count - m))
            groups.setdefault(free - length, []).append(([*pattern, length], m))
            n -= m
    return [g for all_ in groups.values() for g in all_]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and their number of sequences, for exactly the pieces of a histogram.

    The fractional solution of the configuration program is rounded down, then full
    patterns are rounded up, those of the largest fractions first, as far as pieces
    last; what the rounding leaves is packed by best fit. The histogram has at most ``capacity`` lengths,
    so neither the work nor the plan grows with the input.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError("a piece has 1 to capacity tokens")
        counts[length] = n
    out = [([capacity], int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    solution, _, _ = configurations(counts, capacity)
    left, times = counts.copy(), dict.fromkeys(solution, 0)

    def take(pattern: tuple, n: int) -> None:
        n = min([n, *(int(left[k]) // m for k, m in pattern)])
        times[pattern] += n
        for k, m in pattern:
            left[k] -= m * n

    for pattern, x in sorted(solution.items(), key=lambda p: (-p[1], p[0])):
        take(pattern, int(x + 1e-9))
    for pattern, _ in sorted(solution.items(), key=lambda p: (-(p[1] % 1), p[0])):
        if sum(k * n for k, n in pattern) == capacity:
            take(pattern, 1)
    out += [([k for k, n in pattern for _ in range(n)], n) for pattern, n in times.items() if n]
    return out + best_fit(left, capacity)


def _slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and length: the ranks among pieces of this length that go there (from, before), how many a sequence takes, its first sequence, the first one's place."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            k = lengths.count(length)
            first = ranks.get(length, 0)
            ranks[length] = first + k * times
            out.append((length, first, first + k * times, k, sequence, at))
            at += k * length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id``, ``piece``, ``start``, ``length``, others go along).

    Every piece of a sequence of at most ``capacity`` tokens has its own place; the
    places are gapless from 0. ``pieces`` should be a written table: it is read
    three times. Only the histogram of lengths comes to the driver's plan. Pieces of one
    length are dealt by hash over lanes of about ``LANE`` rows, so a frequent length is in many
    tasks, and numbered within each lane.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity))
    # at most capacity lengths, whatever the input
    lanes = spark.createDataFrame([(length, n // LANE + 1) for length, n in histogram.items()], "length bigint, _lanes bigint")
    laned = pieces.join(F.broadcast(lanes), "length").withColumn("_lane", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("_lanes")))
    counts = laned.groupBy("length", "_lane").agg(F.count("*").alias("_n"))
    before = counts.selectExpr("length", "_lane", "sum(_n) over (partition by length order by _lane rows between unbounded preceding and current row) - _n as _before")
    ranked = laned.selectExpr("*", "row_number() over (partition by length, _lane order by doc_id, piece, start) - 1 as _at")
    ranked = ranked.join(before, ["length", "_lane"]).withColumn("_rank", F.col("_at") + F.col("_before"))
    schema = "length bigint, _first bigint, _end bigint, _k bigint, _sequence bigint, _place bigint"
    places = spark.createDataFrame(slots, schema)
    # at most capacity lengths in a few thousand patterns, whatever the input
    ranked = ranked.join(F.broadcast(places), "length").where("_rank >= _first and _rank < _end")
    turn = F.col("_rank") - F.col("_first")
    columns = [c for c in pieces.columns]
    return ranked.select(*columns, (F.col("_sequence") + F.floor(turn / F.col("_k"))).alias("sequence_id"), (F.col("_place") + turn % F.col("_k") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is the ids of its text (null: empty) and the id ``END``. Longer ones
    are cut, into pieces of full length after a first that may be shorter. Returns
    per piece ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``. Other columns of ``docs`` are not read; repeated rows are packed as
    often as they occur, null ids included; an empty table gives an empty result.
    """
    return pack(keep(tokenize(docs, capacity, path), "pieces"), capacity)
