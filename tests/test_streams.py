import pytest

from tidelog.streaming import sessions

COLUMNS = sessions.FRAGMENT


def run(spark, tmp_path, batches, build, mode, schema=COLUMNS):
    """Rows that a stream gives for each batch of rows, one file a batch."""
    source, out = str(tmp_path / "in"), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        got = []
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
            .foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        )
        ended = query.awaitTermination(100)
        if not ended:
            query.stop()
            pytest.fail("the stream did not end")
        out.append(got)
    return out


def test_ingest_stream(spark, tmp_path):
    wide = COLUMNS + ", watermark_ms bigint"
    batches = [
        [(1, 0, 0, 100, "a", 10, 50), (1, 1, 100, 200, "b", 11, 50), (1, 1, 100, 200, "b", 12, 50)],
        [(1, 0, 0, 100, "a", 20, 50), (1, 0, 0, 100, "x", 21, 50), (1, 1, 100, 210, "y", 22, 50), (2, 0, 0, 1, "z", 23, None)],
        [(1, 1, 100, 210, "y", 30, 50), (2, 0, 0, 2, "z", 31, None)],
    ]
    first, second, third = run(spark, tmp_path, batches, sessions.ingest_stream, "append", wide)
    assert sorted(first) == [(1, 0, "new", 10), (1, 1, "duplicate_no_op", 11), (1, 1, "new", 11)]
    assert sorted(second) == [(1, 0, "duplicate_no_op", 10), (1, 0, "duplicate_rejected", 10), (1, 1, "replaced", 11), (2, 0, "new", 23)]
    assert sorted(third) == [(1, 1, "duplicate_no_op", 11), (2, 0, "replaced", 23)]


def test_gap_stream_ages_the_gaps_of_silent_sessions(spark, tmp_path):
    batches = [
        [(1, 0, 0, 100, "a", 1_000), (1, 1, 150, 200, "b", 1_000), (2, 0, 0, 10, "c", 1_000), (3, 0, 0, 10, "d", 1_000), (3, 1, 20, 30, "e", 1_000)],
        [(3, 2, 10, 20, "f", 2_000)],
        [(2, 1, 10, 20, "g", 60_000)],
        [(2, 2, 20, 30, "h", 61_000)],
    ]
    found = run(spark, tmp_path, batches, sessions.gap_stream, "update")
    assert sorted(found[0]) == [(1, 100, "blocked", 0), (2, 10, "ok", 0), (3, 10, "blocked", 0)]
    assert found[1] == [(3, 30, "ok", 0)]
    assert sorted(found[2] + found[3]) == [(1, 200, "degraded", 1), (2, 20, "ok", 0), (2, 30, "ok", 0)]
