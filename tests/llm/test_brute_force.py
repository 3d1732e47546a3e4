"""Operators that SQL cannot express, against plain versions of their own."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

from tidelog.llm import licenses, secrets, sharding, toxicity, winnowing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, next string, picks string").repartition(3)


def winnowed(text, gram, window):
    """Selected grams as pairs of place and 31 bits of hash, in order of places."""
    words = SPACE.findall(text or "")
    if not words:
        return []
    grams = []
    for i in range(max(len(words) - gram + 1, 1)):
        h = 42
        for w in words[i : i + gram]:
            h = xxhash.xxh64_intdigest(w, seed=h)
        grams.append(h & 0x7FFFFFFF)
    picked = set()
    for end in range(len(grams)):
        around = range(max(0, end - window + 1), end + 1)
        picked.add(min(around, key=lambda i: (grams[i], -i)))
    return [(i, grams[i]) for i in sorted(picked)]


@pytest.mark.parametrize(("gram", "window"), [(2, 8), (3, 4), (1, 1)])
def test_winnowing_against_a_plain_version(spark, gram, window):
    rng = random.Random(gram)
    texts = [None, "", " \n", "a", "a b", "é漢 b\tc"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(40)] + ["a " * 300]
    docs = rows_of(spark, texts)
    plain = [winnowed(t, gram, window) for t in texts]
    for r in winnowing.fingerprints(docs, gram, window).collect():
        assert list(zip(r.places, r.hashes, strict=True)) == plain[r.doc_id]

    def likeness(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    def written(picks):
        return "".join(f"{h:08x}" for _, h in picks)

    for r in winnowing.compare_edited(docs, gram, window).collect():
        text, following = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = winnowed(text[: len(text) - cut] + following[:cut], gram, window)
        assert (r.fingerprint, r.edited_fingerprint) == (written(plain[r.doc_id]), written(edited))
        assert r.near_edited == pytest.approx(likeness(plain[r.doc_id], edited))
        assert r.near_next == pytest.approx(likeness(plain[r.doc_id], winnowed(following, gram, window)))


def test_markov_spans_against_a_plain_version(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    names = "resolveResponseBuffer", "ACCOUNT_INDEX_TABLE_ROW", "path/to/session/handle", "q" * 30
    texts = [None, "", *names]
    for _ in range(60):
        pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(15, 45))), rng.choice(names), "plain", "token=" + "".join(rng.choices(letters, k=24)), "0123456789abcdef" * 2]
        texts.append(" é ".join(rng.sample(pieces, rng.randrange(1, 5))))
    docs = rows_of(spark, texts)
    table = secrets.trained(docs)
    steps = [float(f"{x:.5f}") for x in table]
    size, found_any = len(secrets.ALPHABET), 0
    for r in secrets.scan(docs, table).collect():
        text = texts[r.doc_id] or ""
        spans = []
        for rank, (kind, pattern) in enumerate([("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]):
            for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else re.A):
                if len(m[m.re.groups]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), rank, m.end(), kind))
        base = list(spans)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            places = [secrets.ALPHABET.index(c) for c in m[0]]
            mean = sum(steps[a * size + b] for a, b in zip(places, places[1:], strict=False)) / (len(places) - 1)
            if mean >= secrets.THRESHOLD and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                spans.append((m.start(), 3, m.end(), "markov"))
        found_any += len(spans) - len(base)
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    assert found_any > 10


def distances(body, word):
    """Edits from ``body`` to each beginning of ``word``."""
    row = list(range(len(word) + 1))
    for i, a in enumerate(body):
        last, row[0] = row[0], i + 1
        for j, b in enumerate(word):
            last, row[j + 1] = row[j + 1], min(last + (a != b), row[j] + 1, row[j + 1] + 1)
    return row


def test_automata_against_edit_distances():
    rng = random.Random(11)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randrange(a, b)))
    bodies = sorted({word(3, 14) for _ in range(40)})
    entries = [b + "*" * rng.randrange(2) for b in bodies]
    automaton = toxicity.TrieAutomaton(entries)
    hit = 0
    for _ in range(3000):
        w = word(1, 16)
        if rng.random() < 0.5:
            w = rng.choice(bodies)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w = w[:at] + word(0, 2) + w[at + rng.randrange(2) :]
        found = []
        for e in entries:
            body = e.rstrip("*")
            d = distances(body, w)
            least = min(d) if e.endswith("*") else d[-1]
            if least <= toxicity.TrieAutomaton.edits(body, e.endswith("*")):
                found.append((least, e))
        assert automaton.match(w) == min(found, default=None), w
        hit += bool(found)
    assert 300 < hit < 2900


def test_held_out_labels_are_not_learned_from(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(20)) + (" grumbold" if i % 3 == 0 else "") for i in range(240)]
    docs = rows_of(spark, texts)
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = [(i, int(i % 3 == 0)) for i in range(240)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, toxic int")
    a = {r.doc_id: (r.score, r.held_out) for r in toxicity.score(docs, frame(labels)).collect()}
    b = {r.doc_id: (r.score, r.held_out) for r in toxicity.score(docs, frame([(i, 1 - t if i in held else t) for i, t in labels])).collect()}
    assert a == b
    assert {i for i, (_, h) in a.items() if h} == held
    assert all((s >= 0.5) == (i % 3 == 0) for i, (s, _) in a.items())


def as_pattern(markup):
    """Regular expression over words that each end in a space."""
    out = ""
    for part in re.findall(r"\[\[.*?\]\]|\{\{\d+-\d+\}\}|\S+", markup):
        if part.startswith("[["):
            out += "(?:" + "|".join("".join(w + " " for w in c.split()) for c in part[2:-2].split("|")) + ")?"
        elif part.startswith("{{"):
            out += r"(?:\S+ ){" + part[2:-2].replace("-", ",") + "}"
        else:
            out += part + " "
    return re.compile(out)


def test_templates_against_regular_expressions(spark):
    templates = {"one": ["a b [[c|d e]] {{0-2}} a"], "two": ["b {{1-3}} [[a]] c c"], "three": ["c [[a b|a]] b a {{2-2}} d"]}
    rng = random.Random(9)
    texts = [None, ""] + [" ".join(rng.choice("abcde") for _ in range(rng.randrange(25))) for _ in range(300)]
    seen = set()
    for r in licenses.scan_licenses(rows_of(spark, texts), templates, {"e e d": "base"}).collect():
        words = (texts[r.doc_id] or "").split()
        tails = ["".join(w + " " for w in words[i:]) for i in range(len(words))]
        places = [i for i in range(len(words)) if words[i : i + 3] == ["e", "e", "d"]]
        labels = {k for k, ms in templates.items() for m in ms if any(as_pattern(m).match(t) for t in tails)} | ({"base"} if places else set())
        seen |= labels
        assert r.labels == ",".join(sorted(labels))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert (r.score == 1.0) == bool(labels) and 0 <= r.score <= 1
    assert seen == {"one", "two", "three", "base"}


def test_shards_take_turns():
    shards, slots = [f"s{i}" for i in range(7)], 101
    table = sharding.fill_table(shards, slots)
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    starts = [int.from_bytes(d[:8], "big") % slots for d in digests]
    steps = [int.from_bytes(d, "big") % (slots - 1) + 1 for d in digests]
    orders = [[(a + k * b) % slots for k in range(slots)] for a, b in zip(starts, steps, strict=True)]
    assert all(sorted(o) == list(range(slots)) for o in orders)
    owner = {}
    for turn in range(slots):
        shard = turn % len(shards)
        owner[next(s for s in orders[shard] if s not in owner)] = shard
    assert table == [owner[s] for s in range(slots)]
