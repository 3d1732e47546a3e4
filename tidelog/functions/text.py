"""Text functions of the event log, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the entry syntax; wider than the JVM's ``\s``.
SPACE = r"[\s\u000B   -     　﻿]"
_WS = SPACE.replace(r"\s", r" \t\n\r\f")
_MODIFIER = r"\[([A-Za-z][A-Za-z0-9_]*)(?:" + _WS + r"+([^\[\]]*))?\]"
_HEAD = r"\A" + _WS + r"*[A-Za-z][A-Za-z0-9_]*(?:" + _WS + "*" + _MODIFIER + ")*"
#: What looks like a modifier; none may be in a description. A bracket before a digit is plain text.
_LIKE = r"\[[A-Za-z][A-Za-z0-9_]*(?:" + _WS + r"+[^\]]*)?\]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_WS}+|{_WS}+\z", "")


def normalize_ws(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_WS}+", " "))


def blank_to_null(text: Column) -> Column:
    return F.when(trim_space(text) != "", text)


def entry_type(text: Column) -> Column:
    """The leading word of an entry, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\A" + _WS + r"*([A-Za-z][A-Za-z0-9_]*)", 1), F.lit(""))


def _head(text: Column) -> Column:
    """Type and modifiers, empty if there is no type."""
    return F.regexp_extract(text, _HEAD, 0)


def _modifiers(head: Column) -> Column:
    names = F.regexp_extract_all(head, F.lit(_MODIFIER), F.lit(1))
    values = F.transform(F.regexp_extract_all(head, F.lit(_MODIFIER), F.lit(2)), lambda v: trim_space(F.coalesce(v, F.lit(""))))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    lasting = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(lasting)


def modifiers(text: Column) -> Column:
    """``[name value]`` groups after the type as a map; of repeated names the last holds; a bare ``[name]`` has an empty value."""
    return _modifiers(_head(text))


def _description(text: Column, head: Column) -> Column:
    return F.when(head == "", "").otherwise(trim_space(F.substring(text, F.length(head) + 1, F.length(text))))


def description(text: Column) -> Column:
    """What follows type and modifiers, trimmed."""
    return _description(text, _head(text))


def _error(head: Column, rest: Column) -> Column:
    return F.when(head.isNull() | (head == ""), "no type").when(rest.rlike(r"\A" + _LIKE), "bad modifier").when(rest.rlike(_LIKE), "modifier after description")


def parse_error(text: Column) -> Column:
    """Why an entry is not well formed, else null."""
    return _error(_head(text), description(text))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, also where a filter on the result is pushed below it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _core(text: Column) -> Column:
    """``error``, ``head``, ``type`` and ``description`` of an entry as a struct; the last two are null with an error."""

    def told(head: Column, rest: Column, error: Column) -> Column:
        return F.struct(error.alias("error"), head.alias("head"), F.when(error.isNull(), entry_type(head)).alias("type"), F.when(error.isNull(), rest).alias("description"))

    def split(t: Column) -> Column:
        return _bound(_head(t), lambda head: _bound(_description(t, head), lambda rest: _bound(_error(head, rest), lambda error: told(head, rest, error))))

    return _bound(text, split)


def parsed(log: DataFrame, column: str = "input", mode: str = "PERMISSIVE") -> DataFrame:
    """Add ``type``, ``description``, ``modifiers``, ``hashtags``, ``parse_error``.

    In the default mode a malformed entry has an error and null parts; ``FAILFAST``
    raises on it when it is met.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"unknown mode: {mode}")
    text, core = F.col(column), F.col("_tl_core")
    error = core["error"]
    if mode == "FAILFAST":
        error = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("malformed entry: "), error))).cast("string")
    return (
        log.withColumn("_tl_core", _core(text))
        .withColumns({"parse_error": error, "type": core["type"], "description": core["description"], "modifiers": F.when(core["error"].isNull(), _modifiers(core["head"])), "hashtags": hashtags(text)})
        .drop("_tl_core")
    )


def hashtags(text: Column) -> Column:
    """Distinct tags in order of first occurrence: word characters, hyphens within."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)"), F.lit(1)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def comparison_word(word: Column) -> Column:
    """Lower case, letters, digits, hyphen and apostrophe only, none of the last two at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[^a-z0-9'-]", ""), "^[-']+|[-']+$", "")


def word_subset(a: Column, b: Column) -> Column:
    """Every word of ``a`` occurs in ``b``, compared by ``comparison_word``."""
    kept = lambda t: F.filter(F.transform(words(t), comparison_word), lambda w: w != "")
    return F.size(F.array_except(kept(a), kept(b))) == 0


def overlap(a: Column, b: Column, marker: str = "[10-second overlap]") -> Column:
    """Struct of ``length`` (words in the longest run that ends text ``a`` and starts text ``b``, up to case and punctuation; 0 without one) and ``merged`` (see ``merge_overlap``).

    Both texts are split and folded once. Only beginnings of ``b`` that end in the last word of ``a`` are compared.
    """
    folded = lambda ws: F.transform(ws, comparison_word)
    both = F.transform(F.array(F.struct(words(a).alias("aw"), words(b).alias("bw"))), lambda s: F.struct(s["aw"].alias("aw"), s["bw"].alias("bw"), folded(s["aw"]).alias("x"), folded(s["bw"]).alias("y")))

    def longest(s: Column) -> Column:
        x, y, n = s["x"], s["y"], F.size(s["x"])
        same = F.filter(F.transform(y, lambda w, i: F.when((i < n) & (w != "") & (w == F.element_at(x, -1)), i + 1)), lambda k: k.isNotNull())
        fits = F.filter(same, lambda k: (F.slice(x, -k, k) == F.slice(y, 1, k)) & ~F.array_contains(F.slice(y, 1, k), ""))
        return F.when((n > 0) & (F.size(y) > 0), F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)

    def joined(s: Column, k: Column) -> Column:
        tail = F.slice(s["bw"], k + 1, F.greatest(F.size(s["bw"]), F.lit(1)))
        whole = F.when(k > 0, F.array_join(F.concat(s["aw"], tail), " ")).otherwise(F.concat(a, F.lit(f" {marker} "), b))
        return F.when(F.coalesce(F.size(s["aw"]), F.lit(0)) == 0, b).when(F.coalesce(F.size(s["bw"]), F.lit(0)) == 0, a).otherwise(whole)

    measured = F.transform(both, lambda s: F.struct(s.alias("s"), longest(s).alias("k")))
    return F.transform(measured, lambda m: F.struct(m["k"].alias("length"), joined(m["s"], m["k"]).alias("merged")))[0]


def overlap_length(a: Column, b: Column) -> Column:
    """Words in the longest run that ends text ``a`` and starts text ``b``, up to case and punctuation; 0 without one."""
    return overlap(a, b)["length"]


def merge_overlap(a: Column, b: Column, marker: str = "[10-second overlap]") -> Column:
    """Join two transcripts at their overlap; without one, with a marker between. A blank side gives the other."""
    return overlap(a, b, marker)["merged"]


def combination_valid(result: Column, a: Column, b: Column) -> Column:
    """``result`` is a beginning of ``a`` followed by an end of ``b``, word by word: what it shares with the beginning of ``a`` and with the end of ``b`` covers it."""
    norm = lambda t: F.filter(F.transform(words(t), comparison_word), lambda w: w != "")

    def shared(u: Column, v: Column) -> Column:
        """Length of the common beginning of two arrays."""
        n = F.least(F.size(u), F.size(v))
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.array_min(F.filter(places, lambda i: F.element_at(u, i) != F.element_at(v, i))) - 1, n)

    bound = F.transform(F.array(F.struct(norm(result).alias("r"), norm(a).alias("x"), norm(b).alias("y"))), lambda s: F.struct(s.alias("s"), F.reverse(s["r"]).alias("rr"), F.reverse(s["y"]).alias("ry")))
    return F.transform(bound, lambda t: shared(t["s"]["r"], t["s"]["x"]) + shared(t["rr"], t["ry"]) >= F.size(t["s"]["r"]))[0]


def hold_back_tail(text: Column) -> Column:
    """A transcript without its last word, which may be cut off, as a struct of ``head`` and ``tail``.

    With fewer than two words, or under four characters before the last, nothing is held back.
    """
    w = words(text)
    initial = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    few = (F.size(w) < 2) | (F.length(F.array_join(initial, "")) < 4)
    return F.struct(F.when(few, text).otherwise(F.array_join(initial, " ")).alias("head"), F.when(few, "").otherwise(F.element_at(w, -1)).alias("tail"))


def reappend_tail(head: Column, tail: Column) -> Column:
    return F.trim(F.concat_ws(" ", head, tail))


def question_budget(n_words: Column) -> Column:
    """How many questions a new portion of so many words allows."""
    return F.when(n_words < 10, 0).when(n_words < 30, 1).when(n_words < 60, 2).otherwise(5)


def node_id(index: Column, fingerprint: Column) -> Column:
    """Base-36 index, a hyphen, and the replica's fingerprint."""
    return F.concat(F.lower(F.conv(index.cast("string"), 10, 36)), F.lit("-"), fingerprint)


def valid_fingerprint(fingerprint: Column) -> Column:
    return fingerprint.rlike(r"\A[a-z]{9,}\z")


def encode_segment(segment: Column) -> Column:
    """Path segment of a key part: percent, slash and exclamation mark are escaped; the empty segment and those of one or two dots have codes of their own."""
    out = F.replace(F.replace(F.replace(segment, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("!"), F.lit("%21"))
    return F.when(segment == "", "%00").when(segment == ".", "%2E").when(segment == "..", "%2E%2E").otherwise(out)


def decode_segment(segment: Column) -> Column:
    """The key part of a path segment; codes may be in either case."""
    code = F.upper(segment)
    out = F.replace(F.replace(F.regexp_replace(segment, "(?i)%2f", "/"), F.lit("%21"), F.lit("!")), F.lit("%25"), F.lit("%"))
    return F.when(code == "%00", "").when(code == "%2E", ".").when(code == "%2E%2E", "..").otherwise(out)


def question_key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD, lower case, without punctuation and symbols, white space collapsed; marks stay."""
    for s in texts:
        yield s.map(lambda t: None if t is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", t).lower() if unicodedata.category(c)[0] not in "PS").split()))


def fold_question(text: Column) -> Column:
    """Key under which two questions count as the same. Spark has no Unicode normalisation, so this is a pandas function."""
    return F.pandas_udf(question_key, "string")(text)


def rewrite_shortcuts(log: DataFrame, rules: list[tuple[str, str]], column: str = "input", rounds: int = 100) -> DataFrame:
    """Apply shortcut rules until nothing changes.

    The first rule (pattern, replacement) that changes the text is applied to all of
    its places, then the search starts again with the first rule. A text that still
    changes after ``rounds`` applications raises an error.
    """
    import re

    compiled = [(re.compile(p), re.sub(r"\$(?=[0-9])", r"\\", r)) for p, r in rules]

    def settle(text: str | None) -> str | None:
        for _ in range(rounds):
            if text is None:
                return None
            changed = next((new for p, r in compiled if (new := p.sub(r, text)) != text), None)
            if changed is None:
                return text
            text = changed
        raise ValueError(f"shortcuts do not settle after {rounds} rounds")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(settle)

    return log.withColumn(column, F.pandas_udf(run, "string")(F.col(column)))
