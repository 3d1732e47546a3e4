"""Toxicity scores: Levenshtein automata over a lexicon trie, and context windows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import keep

#: Labelled rows that the lexicon and the weights are learned from, at most; entries of the lexicon, at most.
TRAIN_ROWS, LEXICON = 40_000, 400
#: Toxic rows with a term, at least: a number, and a share of all toxic rows; and the share of toxic ones among its rows, at least.
SUPPORT, SHARE, PRECISION = 4, 0.01, 0.7
#: Words to each side of a term that make its context.
CONTEXT = 5
#: Lengths of stems (beginnings of words) in the lexicon.
STEMS = (3, 4, 5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_](?:[\w*@$'’-]*[^\W_])?")
#: Signs and words of quotation or report near a term.
QUOTES = "\"'«»“”„‘’"
REPORTS = frozenset("said says wrote called quoted quote term word insult slur dit mot sagte wort dijo palabra".split())


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class TrieAutomaton:
    """Levenshtein automata of all lexicon entries at once, intersected with their trie.

    An entry that ends in ``*`` stands for all words that begin with it. ``match``
    gives the entry with the fewest edits, up to ``edits(len(entry))``, or None. States
    are sets of (trie node, edits); they are worked out when first met.
    """

    def __init__(self, entries: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        self.stem: list[bool] = [False]
        self.allowed: list[int] = [0]
        for e in sorted(entries):
            node, body = 0, e.rstrip("*")
            path = [0]
            for c in body:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                    self.stem.append(False)
                    self.allowed.append(0)
                node = self.children[node][c]
                path.append(node)
            if self.entry[node] is None or e.endswith("*"):
                self.entry[node], self.stem[node] = e, e.endswith("*")
            for n in path:
                self.allowed[n] = max(self.allowed[n], self.edits(body, e.endswith("*")))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.start = self._state(self._insert_free({(0, 0)}))

    @staticmethod
    def edits(body: str, stem: bool) -> int:
        """Edits that an entry allows: none for short ones, whose neighbours are ordinary words; two from ten letters on."""
        return 0 if len(body) < 5 or stem and len(body) < 8 else 1 if len(body) < 10 else 2

    def _insert_free(self, items: set[tuple[int, int]]) -> frozenset:
        """Close over characters of entries that the word lacks; keep the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, e = todo.pop(0)
            if best.get(node, 99) <= e or e > self.allowed[node]:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.children[node].values()]
            todo.sort(key=lambda x: x[1])
        return frozenset(best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            found = [(e, self.entry[n]) for n, e in items if self.entry[n] is not None and e <= self.edits(self.entry[n].rstrip("*"), self.stem[n])]
            self.ends.append(min(found) if found else None)
        return self.states[items]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if self.stem[node] and e <= self.edits(self.entry[node].rstrip("*"), True):
                out.add((node, e))  # a stem goes on with any character
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            out.add((node, e + 1))
            out |= {(n, e + 1) for n in self.children[node].values()}
        items = self._insert_free(out)
        return self._state(items) if items else -1

    def match(self, word: str) -> tuple[int, str] | None:
        """Edits and entry of the best match of the whole word."""
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                if len(self.sets) > 50_000:
                    self.__init__([e for e in self.entry if e])
                    return self.match(word)
                to = moves[state][c] = self._move(state, c)
            if to < 0:
                return None
            state = to
        return self.ends[state]


FEATURES = ["some exact", "log exact", "some close", "log close", "rate", "weight", "quoted share"]


class Scorer:
    """Features of a text, and their weighted sum. ``ordinary``: words and stems that are not taken for misspelled entries."""

    def __init__(self, lexicon: dict[str, float], weights: list[float] | None = None, ordinary: frozenset[str] = frozenset()) -> None:
        self.lexicon, self.weights, self.ordinary = lexicon, weights, ordinary
        self.automaton = TrieAutomaton(list(lexicon))
        self.known: dict[str, tuple[int, str]] = {}
        self.clean: set[str] = set()

    def hits(self, words: list[str]) -> dict[str, tuple[int, str]]:
        found = {}
        for w in set(words) - self.clean:
            m = self.known.get(w) or self.automaton.match(w)
            # what begins like an ordinary stem is not a misspelled one
            if m is None or m[0] and (w in self.ordinary or m[1].endswith("*") and w[: len(m[1]) - 1] + "*" in self.ordinary):
                self.clean.add(w)
            else:
                self.known[w] = found[w] = m
        if len(self.clean) > 200_000:
            self.clean.clear()
        return found

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        found = self.hits(words)
        if not found:
            return [0.0] * len(FEATURES)
        exact = close = quoted = total = 0
        weight = 0.0
        spans = [m.span() for m in _WORD.finditer((text or "").lower())]
        low = (text or "").lower()
        for i, w in enumerate(words):
            if w not in found:
                continue
            edits, entry = found[w]
            total += 1
            exact, close = exact + (edits == 0), close + (edits > 0)
            a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
            around = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
            said = any(q in around[0] for q in QUOTES) and any(q in around[1] for q in QUOTES) or not REPORTS.isdisjoint(words[a:b])
            quoted += said
            weight += self.lexicon[entry] * (0.5 if said else 1.0) / (1 + edits)
        return [float(exact > 0), np.log1p(exact), float(close > 0), np.log1p(close), total / len(words), np.log1p(max(weight, 0.0)), quoted / total]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms (words, and stems with a star) and how many toxic and other rows of the partition have them."""
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(words_of(text))
            counts[toxic].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        terms = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])


def count_terms(rows: DataFrame) -> DataFrame:
    """``term`` and how many toxic (``pos``) and other rows (``neg``) of ``text`` and ``toxic`` have it."""
    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_term_counts, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return keep(counts, "terms")


def ordinary_words(counts: DataFrame, lexicon: dict[str, float]) -> frozenset[str]:
    """Words, and stems of the greatest length, within the edits of an entry but not equal to one, that are in other rows and not in toxic ones with the precision of an entry."""
    whole = ~F.endswith("term", F.lit("*")) | (F.length("term") == STEMS[-1] + 1)
    words = counts.where((F.col("neg") > 0) & (F.col("pos") < PRECISION * (F.col("pos") + F.col("neg"))) & whole).select("term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TrieAutomaton(list(lexicon))
        for batch in batches:
            near = [bool(m and m[0]) for m in (automaton.match(x.rstrip("*")) for x in batch.column(0).to_pylist())]
            yield batch.filter(pa.array(near, pa.bool_()))

    return frozenset(r["term"] for r in words.mapInArrow(run, "term string").collect())


def learn_lexicon(rows: DataFrame, size: int = LEXICON, counts: DataFrame | None = None) -> dict[str, float]:
    """Entries and their weights, from rows of ``text`` and ``toxic`` (and their ``count_terms``).

    An entry is in at least ``SUPPORT`` toxic rows and ``SHARE`` of them, and at least
    ``PRECISION`` of its rows are toxic.
    Of a stem and the words and longer stems that begin with it, the stem stays if
    it is in more toxic rows and no less precise. The weight is the log of the odds.
    """
    counts = count_terms(rows) if counts is None else counts
    least = max(SUPPORT, SHARE * rows.where("toxic = 1").count())
    good = counts.where((F.col("pos") >= least) & (F.col("pos") >= PRECISION * (F.col("pos") + F.col("neg"))))
    # the best 20 for each place in the lexicon: stems and what begins with them are both among them
    found = {r["term"]: (r["pos"], r["neg"]) for r in good.orderBy(F.desc(F.col("pos") / (F.col("neg") + 1.0)), F.desc("pos"), "term").limit(20 * size).collect()}
    # a stem stands for several words; one that hardly adds to a single word gives way to it
    top = {}
    for t, (pos, _) in found.items():
        for n in STEMS if not t.endswith("*") else ():
            top[t[:n] + "*"] = max(top.get(t[:n] + "*", 0), pos)
    found = {t: c for t, c in found.items() if not t.endswith("*") or c[0] > 1.2 * top.get(t, 0)}
    worth = lambda t: (found[t][0] / (found[t][1] + 1), found[t][0], not t.endswith("*"), t)
    kept: list[str] = []
    for t in sorted(found, key=worth, reverse=True):
        body = t.rstrip("*")
        if not any(k.endswith("*") and body.startswith(k[:-1]) for k in kept):
            kept = [k for k in kept if not (t.endswith("*") and k.rstrip("*").startswith(body))] + [t]
        if len(kept) >= size:
            break
    return {t: float(np.log((found[t][0] + 0.5) / (found[t][1] + 0.5))) for t in kept}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> list[float]:
    """Logistic regression by Newton's method: the constant, then a weight for each feature."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def held_out(doc_id) -> F.Column:
    """Rows that nothing is learned from: CRC-32 of the doc_id's text is a multiple of 5. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = LEXICON) -> Scorer:
    """Lexicon and weights from labelled documents that are not held out.

    At most ``rows`` labelled documents, the first by a hash of the id, are used. Rows
    with a null id, label or text are left out; of repeated labels the largest holds.
    Without a toxic or another document the score is the toxic share everywhere.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(~held_out(F.col("doc_id"))).where("toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids are broadcast, and the texts stay where they are read
    train = keep(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic"), "labelled")
    counts = count_terms(train)
    lexicon = learn_lexicon(train, size, counts)
    scorer = Scorer(lexicon, ordinary=ordinary_words(counts, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([scorer.features(t.as_py()) for t in batch.column(0)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found.T] + [batch.column(1)], names=[f"f{i}" for i in range(len(FEATURES))] + ["toxic"])

    # equal rows are counted: most texts have no hit at all
    columns = [f"f{i}" for i in range(len(FEATURES))]
    seen = train.select("text", "toxic").mapInArrow(run, ", ".join(f"{c} double" for c in columns) + ", toxic int").groupBy(*columns, "toxic").count().collect()
    n = sum(r["count"] for r in seen)
    toxic = sum(r["count"] for r in seen if r["toxic"])
    if not toxic or toxic == n:
        share = (toxic + 0.5) / (n + 1)
        scorer.weights = [float(np.log(share / (1 - share))), *[0.0] * len(FEATURES)]
        return scorer
    x = np.repeat(np.array([[r[c] for c in columns] for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat([r["toxic"] for r in seen], [r["count"] for r in seen])
    scorer.weights = fit_weights(x, y)
    return scorer


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = LEXICON) -> DataFrame:
    """Toxicity of every document.

    Reads ``doc_id`` and ``text`` of ``docs`` and ``doc_id`` and ``toxic`` of ``labels``.
    Returns one row per row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``
    (1 from 0.5). A score depends on the text alone; null and empty texts have no
    hits, like other texts without any. Repeated rows are scored alike; an empty
    table gives an empty result; without labels the score is 0.5, from no rows.
    """
    scorer = learn(docs, labels, rows, size)
    lexicon, weights, ordinary = scorer.lexicon, scorer.weights, scorer.ordinary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(lexicon, weights, ordinary)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = LEXICON) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns stay."""
    scorer = learn(docs, labels, rows, size)
    lexicon, weights, ordinary = scorer.lexicon, scorer.weights, scorer.ordinary
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(lexicon, weights, ordinary)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
