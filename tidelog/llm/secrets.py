"""Secret scans in DataFrame functions only: base patterns, and Markov models of random strings and identifiers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern of each kind, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
#: A pattern that any kept match contains, to leave most texts alone.
HINTS = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Rows of each class in the training sample, and the mean log-likelihood ratio a step (in nats) from which a string counts as random.
SAMPLES, THRESHOLD = 4_000, 0.7
#: Parts of which the sample's ordinary identifiers consist.
PARTS = "account active add address admin all allow amount apply array async audit auth auto avg back base batch begin bind block body bool bucket buffer build byte cache call cancel chain change char check child city class clean clear click client clone close cloud code column commit common compare config connect content context control convert copy count create current cursor data date day debug decode default delete depth detail device diff digest direct disk display document domain done down draft drop edit email empty enable encode end engine entry error event exact exec exit expand export extra factory fail field file filter find first flag flush folder footer force form format frame free from full function global graph grid group guard handle hash head header height hidden history host hour icon image import index info init inner input insert install invoice item iter join json jump kernel key kind label last layer layout left length level limit line link list load local lock login long loop main manager map mark match max member memory menu merge message meta method min minute mode model module month mouse move name native nested next node null number object offset open option order origin outer output owner page pair panel parent parse part pass path pause payload pixel plan player plugin point policy pool port post prefix prepare press price print process profile project proxy public pull push query queue random range rate read ready record region release reload remote remove render repeat replace report request reset resize resolve response result retry return right role root route row rule run sample save scale scan schema scope screen script scroll search second section select send server service session setting setup shape shared shift show side size slot sort source space split stack stage start state status step stop storage store stream string style submit suffix sum swap switch symbol sync system table target task test text theme thread time timer title toggle total trace track transaction tree trigger type unit update upload url user util valid value vector version view visible wait watch web week width window word worker wrap write year zone"


def _joined(marker: Column) -> Column:
    return F.split(F.lit(PARTS), " ")[F.pmod(marker, F.lit(len(PARTS.split()))).cast("int")]


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``token`` and ``random`` (1 or 0): ``n`` random strings over three alphabets and ``n`` identifiers in three styles."""
    i = F.col("id")
    noise = F.sha2(F.concat(F.lit("sample-"), i.cast("string")), 256)
    base64 = F.base64(F.unhex(noise))
    strings = F.when(i % 4 == 0, F.substring(noise, 1, 40)).when(i % 4 == 1, F.substring(F.upper(F.translate(base64, "+/=", "xyz")), 1, 32)).otherwise(F.substring(base64, 1, 43))
    words = [_joined(F.xxhash64(i, F.lit(k))) for k in range(4)]
    caps = [F.initcap(w) for w in words]
    number = F.when(i % 5 == 0, F.pmod(F.xxhash64(i, F.lit(9)), F.lit(2100)).cast("string")).otherwise("")
    names = F.when(i % 4 == 0, F.concat(words[0], *caps[1:], number)).when(i % 4 == 1, F.upper(F.concat_ws("_", *words))).when(i % 4 == 2, F.concat_ws("-", *words)).otherwise(F.concat_ws("/", *words, number))
    base = spark.range(0, n, 1, 1)
    return base.select(strings.alias("token"), F.lit(1).alias("random")).unionByName(base.select(names.alias("token"), F.lit(0).alias("random")))


def train(samples: DataFrame, words: DataFrame | None = None) -> list[float]:
    """Log-likelihood ratio of every step from one character of ``ALPHABET`` to another, first character by first.

    Two first-order Markov models with add-one counts, from ``samples`` (``token``,
    ``random``) and, if given, ``words`` (``token``) as more ordinary strings. The
    result has as many numbers as the alphabet has pairs, whatever the samples' size.
    """
    if words is not None:
        samples = samples.unionByName(words.select("token", F.lit(0).alias("random")))
    size = len(ALPHABET)
    steps = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    pairs = samples.where(F.length("token") > 1).select("random", F.explode(steps).alias("pair")).groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    counts = {r["pair"]: (r["r"], r["o"]) for r in pairs.where(F.col("pair").rlike(r"\A[A-Za-z0-9+/_=-]{2}\z")).collect()}
    table = []
    for a in ALPHABET:
        row = [counts.get(a + b, (0, 0)) for b in ALPHABET]
        r, o = (sum(x[k] for x in row) + size for k in (0, 1))
        table += [math.log((x[0] + 1) / r) - math.log((x[1] + 1) / o) for x in row]
    return table


def corpus_words(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """At most ``n`` distinct lower-case words of 8 to 40 letters, the first by hash, as samples of the corpus's ordinary strings.

    ``n`` is the bound of this training sample; words are picked from all rows.
    """
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z][a-z]{7,39})\b"), F.lit(1)))
    picked = docs.select(F.slice(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("token")))), 1, 2).alias("w"))
    return picked.select(F.explode("w").alias("w")).select("w.h", "w.token").distinct().orderBy("h").limit(n).select("token")


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a step; 0 for tokens of one character."""
    values = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(values, at(i) * len(ALPHABET) + at(i + 1)))
    return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(0.0)


def _matches(text: Column, pattern: str, hint: str, group: int) -> Column:
    """Leftmost non-overlapping matches: structs of ``start``, ``end`` (code points), ``whole`` and ``value`` (a group).

    The pieces between the matches come from a split by the same pattern; lengths
    added up give the places.
    """
    pieces, whole = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    kind = "struct<at:int,out:array<struct<start:int,end:int,whole:string,value:string>>>"
    none = F.from_json(F.lit('{"at":0,"out":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("whole"), x["value"].alias("value")))).alias("out"))

    both = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value"))
    return F.when(text.rlike(hint), F.aggregate(both, none, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,whole:string,value:string>>"))


def _long_enough(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.length(m["value"]) >= LEAST[kind]


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _as_spans(matches: Column, rank: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(
        "array<struct<start:int,rank:int,end:int,kind:string>>"
    )


def with_spans(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Add ``_tl_base`` and ``_tl_spans``: arrays of ``start``, ``rank``, ``end``, ``kind``, sorted; ``docs`` has ``text``, not null.

    ``_tl_base`` has the matches of the patterns, ``_tl_spans`` also strings of kind ``markov``
    that look random under the models and touch no base match.
    """
    text = F.col("text")
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        docs = docs.withColumn(f"_tl_{kind}", _matches(text, pattern if kind == "assign" else pattern[:-1] + "{%d,}" % (LEAST[kind] - 4 * (kind == "access")), HINTS[kind], int(kind == "assign")))
        docs = docs.withColumn(f"_tl_{kind}", _as_spans(F.filter(f"_tl_{kind}", _long_enough(kind)), rank, kind))
    docs = docs.withColumn("_tl_base", F.array_sort(F.concat(*[F.col(f"_tl_{k}") for k in PATTERNS]))).drop(*[f"_tl_{k}" for k in PATTERNS])
    docs = docs.withColumn("_tl_c", _matches(text, CANDIDATE, CANDIDATE, 0))
    free = F.filter("_tl_c", lambda m: ~F.exists("_tl_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & (ratio(m["value"], table) >= threshold))
    return docs.withColumn("_tl_spans", F.array_sort(F.concat("_tl_base", _as_spans(free, len(PATTERNS), "markov")))).drop("_tl_c")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def trained(docs: DataFrame) -> list[float]:
    return train(labelled_samples(docs.sparkSession), corpus_words(docs))


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Secrets in every text.

    Reads ``doc_id`` and ``text``. Returns one row per row: ``doc_id``, ``n_assign``,
    ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``; a span is written
    ``kind:start:end`` in code points, the end exclusive. ``table`` has the models (see
    ``train``); without it they are trained on the built-in samples and a bounded
    sample of the corpus's words.

    Null and empty texts have no spans. Each row is judged by itself: repeated rows
    and null ids need no rule. An empty table gives an empty result.
    """
    table = trained(docs) if table is None else table
    rows = with_spans(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), table, threshold)
    counts = [F.size(F.filter("_tl_base", _is(k))).cast("bigint").alias(f"n_{k}") for k in PATTERNS]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("_tl_base")), 256).alias("base_sha256"), _written(F.col("_tl_spans")).alias("spans"))


def redact(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, overlapping ones by one; ``n_chars``, if there, follows.

    All columns and rows stay; null texts stay null.
    """
    table = trained(docs) if table is None else table
    found = with_spans(docs.withColumns({"_tl_was": F.col("text"), "text": F.coalesce(F.col("text"), F.lit(""))}), table, threshold)
    start = F.from_json(F.lit('{"at":0,"out":""}'), "struct<at:int,out:string>")

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate("_tl_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = found.withColumn("text", F.when(F.col("_tl_was").isNull(), F.lit(None)).when(F.size("_tl_spans") == 0, F.col("text")).otherwise(cut)).drop("_tl_was", "_tl_base", "_tl_spans")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
