import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import keys, media
from tidelog.functions import text as tx
from tidelog.functions import time as tm
from tidelog.operators import bundle, changes, graph, intervals, log, merge
from tidelog.sources.shared import settle
from tidelog.sources.snapshot import scan_snapshot


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def entries(spark, *inputs):
    return tx.parsed(spark.createDataFrame([(i, str(i), "2024-01-01T00:00:00+0000", t) for i, t in enumerate(inputs)], "seq bigint, id string, date string, input string"))


def test_parsing(spark):
    rows = entries(spark, "work [loc office] [loc home][flag] Fixed #a-b ##c #a-b", "text", "[x] no type", "food lunch [when noon]", None).orderBy("seq").collect()
    assert (rows[0].type, rows[0].description) == ("work", "Fixed #a-b ##c #a-b")
    assert rows[0].modifiers == {"loc": "home", "flag": ""} and rows[0].hashtags == ["a-b", "c"]
    assert (rows[1].type, rows[1].description, rows[1].modifiers) == ("text", "", {})
    assert [r.parse_error for r in rows] == [None, None, "no type", "modifier after description", "no type"]


def test_brackets_that_are_no_modifiers(spark):
    rows = entries(spark, "work [123] foo", "work [a b] [x", "work [a b[c] x", "work [] x", "work [a\u00a0b] x", "t x [9 a] [_b]").orderBy("seq").collect()
    assert [(r.description, r.parse_error) for r in rows] == [("[123] foo", None), ("[x", None), (None, "bad modifier"), ("[] x", None), ("x", None), ("x [9 a] [_b]", None)]
    assert rows[1].modifiers == {"a": "b"} and rows[4].modifiers == {"a": "b"}


def test_order_and_pages(spark):
    own = entries(spark, *[f"text n{i}" for i in range(25)])
    assert [r.seq for r in log.first_entries(own, 3, "desc").collect()] == [0, 1, 2]
    assert [r.seq for r in log.first_entries(own, 3, "asc").collect()] == [24, 23, 22]
    assert log.page(own, 2, 20).count() == 5 and log.page(own, 1, 20).count() == 21
    assert log.search(own, "N1.").count() == 10
    with pytest.raises(log.InvalidSearch):
        log.search(own, "(")
    assert log.page_arguments({"order": "dateAscending"})["order"] == "asc" and log.page_arguments({"order": ["asc"]})["order"] == "desc"
    assert log.page_arguments({"page": ["3", "4"], "limit": "900", "order": "up"}) == {"page": 3, "limit": 100, "order": "desc", "pattern": None}


def test_context(spark):
    own = entries(spark, "text #work a", "other #work b", "register #home c", "other d", "photo #work #home e")
    found = {r.e_id: r.context for r in log.event_context(own).collect()}
    assert found == {"0": ["0", "4"], "1": ["0", "1", "4"], "2": ["2", "4"], "3": ["3"], "4": ["0", "2", "4"]}


def test_context_sizes_agree_with_contexts(spark):
    rng = random.Random(5)
    tags = [f"t{i}" for i in range(14)]
    rows = [(str(i), i, rng.choice(["text", "other", None]), rng.choice([None, []] + [rng.choices(tags, k=n) for n in (1, 2, 3, 8, 9, 12)])) for i in range(120)]
    own = spark.createDataFrame(rows, "id string, seq bigint, type string, hashtags array<string>")
    counted = {r.e_id: r.n for r in log.context_sizes(own).collect()}
    listed = {r.e_id: len(r.context) for r in log.event_context(own).collect()}
    assert counted == listed and len(counted) == 120


def exchanged(df):
    """Rows that the shuffles of a run of ``df`` take in."""
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "Exchange":
            rows += p.metrics().apply("shuffleRecordsWritten").value()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else []
        todo += inner or [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_contexts_are_found_without_shuffling_pairs(spark, monkeypatch):
    monkeypatch.setattr(log, "LOT_ROWS", 100)
    rows = [(str(i), i, "text", f"2024-01-01T00:00:{i % 60:02d}+0000", "text", ["all", f"t{i % 3}", f"u{i % 50}"][i % 2 :]) for i in range(400)]
    own = spark.createDataFrame(rows, "id string, seq bigint, type string, date string, input string, hashtags array<string>")
    found = log.event_context(own)
    pairs = log.context_pairs(own).groupBy("e_id").agg(F.array_sort(F.collect_list(F.struct("o_seq", "o_id"))).alias("c"))
    assert {r.e_id: r.context for r in found.collect()} == {r.e_id: [x.o_id for x in r.c] for r in pairs.collect()}
    assert exchanged(pairs) > 20_000 and exchanged(found) < 8_000


def test_bundles_take_contexts_along(spark):
    own = entries(spark, "food a #x #y", "text b #x", "photo #y", "food c")
    none = spark.createDataFrame([], "id string, value string, error string, path string, text string")
    asked = spark.createDataFrame([("0",), ("3",), ("9",)], "id string")
    found = bundle.entry_bundle(own, asked, none, none, lambda rows: bundle.add_details(rows, own, told=("date",)))
    listed = {r.id: r.basic_context and [(e.id, e.date) for e in r.basic_context] for r in found.collect()}
    day = "2024-01-01T00:00:00+0000"
    assert listed == {"0": [("0", day), ("1", day), ("2", day)], "3": [("3", day)], "9": None}


def test_rows_with_long_contexts_come_first_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(log, "LOT_ROWS", 5)
    own = entries(spark, *[f"text #{'x' if i % 3 else 'y'} {i}" for i in range(90)])
    asked = spark.range(120).select(F.col("id").cast("string").alias("id"))
    none = spark.createDataFrame([], "id string, value string, error string, path string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bundle.entry_bundle(own, asked, none, none, lambda rows: bundle.add_details(rows, own, told=("date",)))
        rows = found.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), F.coalesce(F.size("basic_context"), F.lit(0)).alias("n")).orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = {t: [r.n for r in rows if r.task == t] for t in {r.task for r in rows}}
    assert len(rows) == 120 and any(len(set(n)) == 3 for n in sizes.values())
    assert all(n == sorted(n, reverse=True) for n in sizes.values())


def test_lists_have_few_copies(spark, monkeypatch):
    monkeypatch.setattr(log, "LOT_ROWS", 2)
    monkeypatch.setattr(log, "COPIES", 4)
    rows = [(str(i), i, "text", "2024-01-01T00:00:00+0000", "text", ["all", f"t{i % 3}", f"u{i % 50}"][i % 2 :]) for i in range(400)]
    own = spark.createDataFrame(rows, "id string, seq bigint, type string, date string, input string, hashtags array<string>")
    written = {}
    monkeypatch.setattr(log, "settle", lambda df, name="step", **more: written.setdefault(name, settle(df, name, **more)))
    found = {r.e_id: r.context for r in log.event_context(own).collect()}
    lots = written["lots"].groupBy("last").agg(F.sum("lots").alias("lots"), F.count("*").alias("tags"), F.max("lots").alias("most")).collect()
    assert all(r.lots <= r.tags + 4 for r in lots) and max(r.most for r in lots) > 1
    pairs = log.context_pairs(own).groupBy("e_id").agg(F.array_sort(F.collect_list(F.struct("o_seq", "o_id"))).alias("c"))
    assert found == {r.e_id: [x.o_id for x in r.c] for r in pairs.collect()}


def test_replay_of_repeated_lives(spark):
    rows = [(0, "a", "add"), (1, "a", "delete"), (2, "a", "add"), (3, "a", "add"), (4, "b", "add"), (5, "b", "edit"), (6, "c", "add"), (7, "c", "delete"), (8, "d", "edit"), (9, "e", "add"), (10, "e", "delete"), (11, "e", "edit")]
    own = spark.createDataFrame([(*r, "x") for r in rows], "change_seq bigint, id string, action string, event string")
    assert {r.id: r.since for r in changes.replay(own).collect()} == {"a": 2, "b": 4, "d": None, "e": 9}


def test_diff_and_replay(spark):
    schema = "seq bigint, id string, v string"
    old = spark.createDataFrame([(0, "a", "1"), (1, "b", None), (2, "c", "3")], schema)
    new = spark.createDataFrame([(0, "b", None), (1, "c", "4"), (2, "d", "5")], schema)
    found = changes.snapshot_diff(old, new)
    assert {(r.action, r.id) for r in found.collect()} == {("delete", "a"), ("edit", "c"), ("add", "d")}
    first = changes.append_changes(None, changes.snapshot_diff(old.limit(0), old))
    both = changes.append_changes(first, found)
    assert [r.change_seq for r in both.orderBy("change_seq").collect()] == list(range(6))
    assert [(r.id, r.event.v) for r in changes.replay(both).orderBy("since").collect()] == [("b", None), ("c", "4"), ("d", "5")]
    assert changes.is_unchanged(old, old)


def test_store_diff_is_idempotent(spark):
    source = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    target = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    after = changes.apply_diff(target, changes.store_diff(source, target))
    assert {tuple(r) for r in after.collect()} == {("a", "1"), ("b", "2")}
    assert changes.store_diff(source, after).where("op <> 'unchanged'").isEmpty()


def naive_previous(cron, at):
    at = at.replace(second=0, microsecond=0)
    while True:
        dow = (at.weekday() + 1) % 7
        by_dom, by_dow = at.day in cron.days, dow in cron.weekdays
        day = by_dom or by_dow if not cron.any_day and not cron.any_weekday else by_dom and by_dow
        if at.minute in cron.minutes and at.hour in cron.hours and at.month in cron.months and day:
            return at
        at -= dt.timedelta(minutes=1)


def test_cron(spark):
    rng = random.Random(3)
    texts = ["0 * * * *", "5,35 9-17 * * 1-5", "0 2 1 * *", "30 4 13 * 5", "* * * * *", "59 23 28-31 * *", "0 0 1-31 * 1", "0 0 15 * 0-6", "0 5 29 2 *"]
    rows = [(t, dt.datetime(2024, 2, 29, 23, 59, 59) + dt.timedelta(minutes=rng.randrange(50_000))) for t in texts for _ in range(2)]
    df = spark.createDataFrame(rows, "cron string, at timestamp").withColumns(tm.cron_columns(F.col("cron")))
    for r in df.select("cron", "at", tm.cron_previous(F.col("at")).alias("p"), tm.cron_next(F.col("at")).alias("n")).collect():
        assert r.p == naive_previous(tm.parse_cron(r.cron), r.at)
        assert naive_previous(tm.parse_cron(r.cron), r.n) == r.n and naive_previous(tm.parse_cron(r.cron), r.n - dt.timedelta(minutes=1)) == r.p
    for bad in ("* * * *", "60 * * * *", "*/5 * * * *", "0 0 * * 7", "5-1 * * * *"):
        with pytest.raises(tm.CronError):
            tm.parse_cron(bad)
        assert one(spark, tm.valid_cron(F.lit(bad))) is not True


def test_overlap(spark):
    a, b = F.lit("we went to the Big house"), F.lit("the big, house was red")
    assert one(spark, tx.overlap_length(a, b)) == 3
    assert one(spark, tx.merge_overlap(a, b)) == "we went to the Big house was red"
    assert one(spark, tx.merge_overlap(F.lit(" "), b)) == "the big, house was red"
    assert one(spark, tx.merge_overlap(F.lit("x"), F.lit("y"))) == "x [10-second overlap] y"


def test_combinations(spark):
    a, b = F.lit("We went home, then"), F.lit("home then out again")
    for text, valid in (("we went home then out again", True), ("we went out again", True), ("", True), ("we home", False), ("went home then", False), ("we went home then home then out again more", False), ("then out again", True)):
        assert one(spark, tx.combination_valid(F.lit(text), a, b)) is valid, text


def test_graph(spark):
    families = graph.default_families()
    assert max(graph.levels(families).values()) == 3
    with pytest.raises(graph.CyclicGraph):
        graph.check_schema([graph.family("a", "b"), graph.family("b", "a")])
    with pytest.raises(graph.InvalidSchema):
        graph.check_schema([graph.family("a(x)"), graph.family("b", "a(x)")])
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "from_id string, to_id string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.id for r in graph.closure(start, steps, 3).collect()} == {"a", "b", "c"}


def test_closure_goes_on_until_nothing_is_new(spark):
    chain = spark.range(12).selectExpr("cast(id as string) as from_id", "cast((id + 1) % 12 as string) as to_id")
    start = spark.createDataFrame([("0",)], "id string")
    assert graph.closure(start, chain).count() == graph.closure(start, chain, 11).count() == 12
    assert graph.closure(start.limit(0), chain).isEmpty()
    with pytest.raises(graph.GraphError):
        graph.closure(start, chain, 3)


def test_merge_prefers_the_later_write(spark):
    schema = "key string, id string, freshness string, created_at string, modified_at string, fingerprint string"
    t = spark.createDataFrame([("a", "1", graph.FRESH, "2024-01-01", "2024-01-02", "f"), ("b", "2", graph.FRESH, "2024-01-01", "2024-01-02", "f")], schema)
    h = spark.createDataFrame([("a", "1", graph.FRESH, "2024-01-01", "2024-01-03", "g"), ("c", "3", graph.FRESH, "2024-01-01", "2024-01-02", "g")], schema)
    edges = spark.createDataFrame([("b", "a")], "key string, input_key string")
    found = {r.key: (r.side, r.outcome) for r in merge.merge_outcomes(t, h, edges, 2).collect()}
    assert found == {"a": ("H", "take"), "b": ("T", "invalidate"), "c": ("H", "take")}


def test_gaps(spark):
    schema = "session_id bigint, sequence bigint, start_ms bigint, end_ms bigint"
    parts = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 150, 200), (1, 2, 90, 120), (1, 3, 300, 400)], schema)
    sessions = spark.createDataFrame([(1, 0, 10_000, 50_000)], "session_id bigint, watermark_ms bigint, deadline_ms bigint, now_ms bigint")
    known = spark.createDataFrame([(1, 120, 150, 0, "waiting")], "session_id bigint, start_ms bigint, end_ms bigint, first_observed_ms bigint, status string")
    progress, gaps = intervals.scan_gaps(parts, sessions, known)
    assert tuple(progress.first()) == (1, 200, False, True)
    assert {(r.start_ms, r.status) for r in gaps.collect()} == {(120, "abandoned"), (200, "waiting")}


def test_day_fields_are_restricted_unless_a_star(spark):
    assert not tm.equivalent(tm.parse_cron("0 0 1-31 * 1"), tm.parse_cron("0 0 * * 1"))
    assert tm.equivalent(tm.parse_cron("0 0 * * 0-6"), tm.parse_cron("0 0 1-31 * *"))


def test_running_tasks_count_for_the_next_due_time(spark):
    tasks = spark.createDataFrame([("a", "0 12 * * *", None, True), ("b", "0 18 * * *", None, False)], "name string, cron string, pending_retry_until timestamp, running boolean")
    r = tm.next_due(tasks, F.lit("2024-03-01 11:00:00").cast("timestamp")).first()
    assert (r.due, r.sleep_ms) == (dt.datetime(2024, 3, 1, 12), 3_600_000)


def test_segments_and_tails(spark):
    parts = ["", ".", "..", "a/b", "!%", "%00", "%2E", "a\x00b", "...", "%2F"]
    df = spark.createDataFrame([(p,) for p in parts], "p string").select("p", tx.encode_segment(F.col("p")).alias("e"))
    rows = df.select("p", "e", tx.decode_segment(F.col("e")).alias("d")).collect()
    assert [r.e for r in rows] == ["%00", "%2E", "%2E%2E", "a%2Fb", "%21%25", "%2500", "%252E", "a\x00b", "...", "%252F"] and all(r.p == r.d for r in rows)
    held = [tuple(one(spark, tx.hold_back_tail(F.lit(t)))) for t in ("hello", "a b c", "we went home", " ")]
    assert held == [("hello", ""), ("a b c", ""), ("we went", "home"), (" ", "")]
    keys = next(tx.question_key(iter([__import__("pandas").Series(["Caf\u00e9?", "cafe!", "CAFE\u0301"])])))
    assert keys[0] == keys[2] != keys[1]


def test_order_of_values():
    rising = [None, False, True, float("-inf"), -2, -1.5, 0, 1e-9, 3, 10, "", "\x00", "a", "ab", "b", "\U0001f600", "\uffff", [], [None], [None, None], [1], [1, 0], ["a"], {}, {"a": 1}, {"a": 1, "b": 0}, {"a": 2}, {"b": 0}]
    found = [keys.value_bytes(v) for v in rising]
    assert found == sorted(found) and len(set(found)) == len(found)
    assert keys.value_bytes(-0.0) == keys.value_bytes(0) and keys.value_bytes({"b": 1, "a": 2}) == keys.value_bytes({"a": 2, "b": 1})


def test_order_of_nodes(spark):
    rows = [("a", "[]"), ("a", '["z"]'), ("a", "[1, 2]"), ("a", "[%s]" % ", ".join(["null"] * 3)), ("a", "[" + "9" * 400 + ", 0, 0]"), ("ab", "[]"), ("b", None), ("b", "x"), (None, "[]")]
    df = spark.createDataFrame(rows, "head string, args string").withColumn("k", keys.node_order(F.col("head"), F.col("args")))
    assert [(r.head, r.args) for r in df.where("k is not null").orderBy("k").collect()] == rows[:6] and df.where("k is null").count() == 3


def test_url_arguments(spark):
    for path, args in (("a/b", ['"a"', '"b"']), ("", []), ("~1/~~1/~[1, 2]/", ["1", '"~1"', "[1, 2]"]), ('a%2Fb/c+d/%22', ['"a/b"', '"c+d"', '"\\""']), ("~x/~%22%22/~~", [None, '"~"'])):
        assert one(spark, keys.url_arguments(F.lit(path))) == args, path


def test_zones(spark):
    for text, zone in (("5", "UTC+5"), ("-07:00", "UTC-7"), ("5:30", "UTC+05:30"), ("-3:05", "UTC-03:05"), ("15", None), ("+14:60", None), ("", None), ("x", None), ("europe/berlin", "europe/berlin"), ("5:3", None), ("5\n", None)):
        assert one(spark, tm.client_zone(F.lit(text))) == zone, text
    at = F.lit("2024-03-01 00:00:00.25").cast("timestamp")
    for zone, text in (("UTC", "2024-03-01T00:00:00.250Z"), ("UTC-03:30", "2024-02-29T20:30:00.250-03:30"), ("Europe/Berlin", "2024-03-01T01:00:00.250+01:00")):
        assert one(spark, tm.iso_in_zone(at, F.lit(zone))) == text


def test_bundles_keep_errors_apart(spark):
    own = entries(spark, "food a #x", "text b #x", "food c")
    calories = spark.createDataFrame([("0", "N/A", None), ("1", None, "no model"), ("2", "300", None)], "id string, value string, error string")
    heard = spark.createDataFrame([("0", "d/b.mp3", None, "late"), ("0", "d/a.mp3", None, "early"), ("1", "d/a.txt", "no", None), ("1", "d/b.ogg", "yes", None), ("1", "d/a.ogg", None, "bad")], "id string, path string, text string, error string")
    asked = spark.createDataFrame([("0",), ("1",), ("2",), ("9",), ("9",)], "id string")
    found = {r.id: r for r in bundle.entry_bundle(own, asked, calories, heard, bundle.context_details(own, asked)).collect()}
    assert {i: (r.calories, r.transcription, r.errors) for i, r in found.items()} == {"0": (None, None, {"transcription": "late"}), "1": (None, "yes", {"calories": "no model"}), "2": ("300", None, {}), "9": (None, None, {})}
    assert [e.id for e in found["0"].basic_context] == ["0", "1"] and found["9"].basic_context is None


def test_inspection(spark):
    nodes = spark.createDataFrame([("1", "event", '["a"]', '{"head":"event","args":["a"]}', graph.FRESH, "2024-01-01", "2024-01-02")], "id string, head string, args string, key string, freshness string, created_at string, modified_at string")
    wish = lambda *rows: spark.createDataFrame(rows, "head string, args string")
    families = graph.default_families()
    assert {(r.args, r.id, r.freshness) for r in graph.inspect(families, wish(("event", '["a"]'), ("event", '["b"]'), ("event", '["b"]')), nodes).collect()} == {('["a"]', "1", graph.FRESH), ('["b"]', None, None)}
    assert graph.modification_times(families, wish(("event", '["a"]')), nodes).first().modified_at == "2024-01-02"
    for error, row in ((graph.UnknownHead, ("nothing", "[]")), (graph.ArityMismatch, ("event", "[]")), (graph.NotMaterialized, ("event", '["b"]'))):
        with pytest.raises(error):
            graph.modification_times(families, wish(row), nodes)


def test_hosts_merge_in_order_and_failures_stay_apart(spark):
    node = "key string, id string, freshness string, created_at string, modified_at string, fingerprint string"
    day = "2024-01-0"
    state = lambda fp, *rows: merge.Replica(spark.createDataFrame([(k, i, f, day + "1", day + m, fp) for k, i, f, m in rows], node), spark.createDataFrame([("b", "a")], "key string, input_key string"), spark.createDataFrame([("a", "b")], "dep_key string, key string"), "1", "s", fp)
    own = state("f", ("a", "1", graph.FRESH, "2"), ("b", "2", graph.FRESH, "2"))
    later = state("g", ("a", "1", graph.FRESH, "3"), ("b", "2", graph.FRESH, "1"))
    merged, changed = merge.merge_replicas(own, later, 2)
    assert changed and {(r.key, r.freshness, r.modified_at) for r in merged.nodes.collect()} == {("a", graph.FRESH, day + "3"), ("b", graph.STALE, day + "2")}
    assert merged.valid.isEmpty() and merged.fingerprint == "f"
    assert merge.merge_replicas(own, state("h", ("a", "1", graph.FRESH, "1"), ("b", "2", graph.FRESH, "1")), 2) == (own, False)
    with pytest.raises(merge.HostFailures) as e:
        merge.merge_hosts(own, {"z": later, "a": state("f"), "c": state("k", ("x", "1", graph.FRESH, "2"))}, 2)
    assert sorted(e.value.failures) == ["a", "c"] and e.value.state.nodes.where("freshness <> 'up-to-date'").count() == 1


def test_wav_files_are_parsed_by_chunks(spark):
    header = media.wav_header(4, 8000, 2, 16)
    other = b"LIST" + (3).to_bytes(4, "little") + b"abc\0"
    files = [header + b"wxyz", header[:12] + other + header[12:] + b"wxyz", media.wav_header(4, 8000, 2, 24) + b"wxyz", header[:20] + b"\3\0" + header[22:] + b"wxyz", header[:36], b"RIFF", b"", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(files)], "n int, wav binary")
    found = [r.p for r in df.select("n", media.parse_wav(F.col("wav")).alias("p")).orderBy("n").collect()]
    assert all((bytes(p.pcm), p.sample_rate, p.channels, p.bit_depth) == (b"wxyz", 8000, 2, 16) for p in found[:2])
    assert found[2:] == [None] * 6
    assert df.limit(0).select(media.parse_wav(F.col("wav")).alias("p")).count() == 0


def test_faults_of_chunks(spark):
    schema = "session_id int, sequence int, start_ms double, end_ms double, pcm binary, sample_rate int, channels int, bit_depth int"
    good = (1, 0, 0.0, 0.0, b"", 1, 1, 16)
    bad = [(1, -1, *good[2:]), (1, None, *good[2:]), (*good[:3], None, *good[4:]), (*good[:4], None, *good[5:]), (*good[:4], b"abc", *good[5:]), (*good[:6], 0, 8)]
    df = spark.createDataFrame([good, *bad], schema)
    assert [r.f for r in df.select(media.chunk_fault(df).alias("f")).collect()] == [None, "sequence", "sequence", "end_ms", "pcm", "frames", "channels"]
    assert [r.session_id for r in media.mixed_sessions(df).collect()] == [1]


def test_questions_are_fetched_once(spark):
    asked = spark.createDataFrame([("a", 1, "q1"), ("a", 3, "q3"), ("a", 3, "q3"), ("a", 9, "q9"), ("b", 1, None)], "session_id string, at int, text string")
    fetches = spark.createDataFrame([("a", 3), ("a", 5), ("a", 0), ("c", 2)], "session_id string, at int")
    found = sorted((r.session_id, r.at, r.fetched_at) for r in intervals.questions_fetched(asked, fetches).collect())
    assert found == [("a", 1, 3), ("a", 3, 3), ("a", 3, 3), ("a", 9, None), ("b", 1, None)]


def test_snapshots_are_scanned(spark, tmp_path):
    names = {"_meta/current": '"x"', "x/values/%00": "{}", "x/values/a%2Fb c+d%25": "[1,\n2]", "y/inputs/é%21": "null"}
    for name, text in names.items():
        file = tmp_path / "snap (1)" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    folder = str(tmp_path / "snap (1)")
    found = {(r.sublevel, r.key): r.value for top in ("_meta", "x", "y") for r in scan_snapshot(spark, folder, top).collect()}
    assert found == {("_meta", "current"): '"x"', ("x/values", ""): "{}", ("x/values", "a/b c+d%"): "[1,\n2]", ("y/inputs", "é!"): "null"}
    (tmp_path / "snap (1)" / "x" / "stray").write_text("1")
    assert scan_snapshot(spark, folder, "x", strict=False).count() == 2
    with pytest.raises(Exception, match="not a path of a key"):
        scan_snapshot(spark, folder, "x").collect()
    with pytest.raises(Exception, match="(?i)path"):
        scan_snapshot(spark, folder, "z").collect()


def most_read(spark, run):
    """The most rows that a task read from shuffles while ``run`` ran."""
    sc, group = spark.sparkContext, f"read-{random.random()}"
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group, "")
    try:
        run()
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker, most = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for stage in {x for j in tracker.getJobIdsForGroup(group) for x in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        most = max([most, *(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))])
    return most


@pytest.fixture
def star(spark, monkeypatch):
    """Nodes, edges and proofs of 2,000 events under one input, of which keys of 500 rows are frequent."""
    from tidelog.sources import shared

    monkeypatch.setattr(shared, "FREQUENT", 500, raising=False)
    ids = spark.range(2000).select(F.concat(F.lit("v-"), "id").alias("id"), F.lit("event").alias("head"), F.to_json(F.array(F.col("id").cast("string"))).alias("args"))
    both = ids.unionByName(spark.range(1).select(F.lit("a-0").alias("id"), F.lit("all_events").alias("head"), F.lit("[]").alias("args")))
    nodes = both.withColumns({"key": graph.node_key(F.col("head"), F.col("args")), "freshness": F.lit(graph.FRESH), "created_at": F.lit("2024-01-01"), "modified_at": F.lit("2024-01-01")})
    edges = ids.select("id", F.lit("a-0").alias("input_id"))
    return nodes, edges, edges.select(F.col("input_id").alias("dep_id"), F.col("id").alias("dependent_id"))


def test_edges_to_one_input_are_derived_by_many_tasks(spark, star):
    nodes, edges, _ = star
    derived = lambda: graph.derive_edges(nodes, graph.scheme_table(spark, graph.default_families()))
    assert {(r.id, r.input_id, r.pos) for r in derived().collect()} == {(r.id, r.input_id, 0) for r in edges.collect()}
    assert most_read(spark, lambda: derived().collect()) < 1500


def test_cache_predicate_of_one_input_is_found_by_many_tasks(spark, star):
    nodes, _, valid = star
    usable = lambda: graph.cache_usable(nodes, graph.derive_edges(nodes, graph.scheme_table(spark, graph.default_families())).select("id", "input_id", "pos"), valid)
    assert usable().where("usable").count() == 2000
    assert most_read(spark, lambda: usable().collect()) < 1500


def test_invariants_of_one_input_are_checked_by_many_tasks(spark, star):
    nodes, edges, valid = star
    assert graph.violations(nodes, valid, edges).isEmpty()
    assert most_read(spark, lambda: graph.violations(nodes, valid, edges).collect()) < 1500
    stale = nodes.withColumn("freshness", F.when(F.col("id") == "a-0", graph.STALE).otherwise(F.col("freshness")))
    assert graph.violations(stale, valid, edges).groupBy("rule").count().collect() == [("fresh on stale input", 2000)]


def test_proofs_of_one_input_are_followed_by_many_tasks(spark, star):
    nodes, _, valid = star
    few = nodes.where("id in ('v-1', 'v-2')").select("id")
    assert graph.stale_closure(valid, few).count() == 2
    assert graph.stale_closure(valid, nodes.where("id = 'a-0'").select("id")).count() == 2001
    assert most_read(spark, lambda: graph.stale_closure(valid, few).collect()) < 1500


def test_levels_under_one_input_are_found_by_many_tasks(spark, star):
    nodes, edges, _ = star
    deep = edges.unionByName(spark.createDataFrame([("v-2", "v-1"), ("v-3", "v-2"), ("v-3", "v-1"), ("v-4", "gone"), ("v-5", None)], "id string, input_id string"))
    found = {r.id: r.level for r in graph.topological_levels(deep, nodes, 3).collect()}
    assert len(found) == 2001 and (found["a-0"], found["v-1"], found["v-2"], found["v-3"], found["v-4"]) == (0, 1, 2, 3, 1)
    for more, depth in (([], 2), ([("v-1", "v-3")], 9), ([("a-0", "a-0")], 9)):
        with pytest.raises(graph.CyclicGraph):
            graph.topological_levels(deep.unionByName(spark.createDataFrame(more, "id string, input_id string")), nodes, depth)
    assert most_read(spark, lambda: graph.topological_levels(deep, nodes, 3).collect()) < 1500


def test_tasks_of_the_cache_predicate_stay_small(spark, monkeypatch):
    from tidelog.sources import shared

    monkeypatch.setattr(shared, "FREQUENT", 500, raising=False)
    monkeypatch.setattr(shared, "TASK_ROWS", 200, raising=False)
    own = spark.range(6000).select(F.concat(F.lit("v-"), "id").alias("id"), F.lit("event").alias("head"), F.to_json(F.array(F.col("id").cast("string"))).alias("args"))
    both = own.unionByName(spark.range(1).select(F.lit("a-0").alias("id"), F.lit("all_events").alias("head"), F.lit("[]").alias("args")))
    nodes = both.withColumn("key", graph.node_key(F.col("head"), F.col("args")))
    edges = own.select("id", F.lit("a-0").alias("input_id"))
    proofs = edges.where("id not like '%7'").unionByName(edges.where("id like '%1'")).select(F.col("input_id").alias("dep_id"), F.col("id").alias("dependent_id"))

    def usable():
        derived = graph.derive_edges(nodes, graph.scheme_table(spark, graph.default_families())).select("id", "input_id", "pos")
        return graph.cache_usable(nodes, derived.unionByName(spark.createDataFrame([("v-1", "gone", 1), ("v-2", None, 1)], derived.schema)), proofs)

    found = {r.id: r.usable for r in usable().collect()}
    assert len(found) == 6001 and {i for i, u in found.items() if not u} == {"a-0", "v-1", "v-2"} | {f"v-{i}" for i in range(7, 6000, 10)}
    assert most_read(spark, lambda: usable().collect()) < 800


def test_frequent_keys_are_found_among_keys_of_their_bucket(spark, monkeypatch):
    from tidelog.sources import shared

    monkeypatch.setattr(shared, "FREQUENT", 50)
    monkeypatch.setattr(shared, "BUCKETS", 2, raising=False)
    many = shared.settle(spark.range(300).select(F.when(F.col("id") < 100, "a").when(F.col("id") < 150, "b").when(F.col("id") < 290, F.col("id").cast("string")).alias("k"), "id"))
    few = spark.createDataFrame([("a", 1), ("b", 2), ("200", 3)], "k string, x int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(shared.meeting(many, "k")(few, how)) == rows(many.join(few, "k", how))


def test_files_of_edges_are_small(spark, star, monkeypatch):
    from tidelog.sources import shared

    monkeypatch.setattr(shared, "FILE_ROWS", 100, raising=False)
    derived = graph.derive_edges(star[0], graph.scheme_table(spark, graph.default_families()))
    rows = [r["count"] for r in derived.groupBy(F.input_file_name()).count().collect()]
    assert sum(rows) == 2000 and max(rows) <= 100
