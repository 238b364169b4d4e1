"""H3 in any order and H4 exactly once, as running streams."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from qcorpus.plans import fixtures
from qcorpus.functions import scoring as S
from qcorpus.streaming import assembly as A
from qcorpus.streaming import events as ST
from tests.conftest import SF_SMALL

PIECE = "request_id long, seq long, token string, done boolean, error string, timestamp timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def messages(spark, tmp, parts, **options):
    """The rows that the stream gives out for parts appended one after another."""
    for part in parts:
        spark.createDataFrame(part, PIECE).coalesce(1).write.mode("append").json(f"{tmp}/log")
        time.sleep(1.1)
    stream = spark.readStream.schema(PIECE).option("maxFilesPerTrigger", 1).json(f"{tmp}/log")
    with A.rocksdb_state(spark):
        out = A.assemble_tokens_ordered(stream, **options)
        out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck") \
            .trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(ST.ASSEMBLED_SCHEMA).parquet(f"{tmp}/out").collect())


def test_shuffled_pieces_late_pieces_and_repeats(spark, tmpdir_path):
    one = [(1, s, f"a{s} ", s == 4, None, at(s)) for s in range(5)]
    parts = [
        [one[4], one[1], (2, 0, "x", False, None, at(1)), (3, 7, "q", False, "broken", at(2)), (3, 6, "p", None, None, at(1))],
        [one[0], one[3], one[1], (2, 1, None, False, None, at(3)), (None, 1, "n", False, None, at(1)), (3, 8, "after", True, None, at(3))],
        [one[2], (2, 2, "y", False, None, at(2))],
        [(9, 0, "clock", False, None, at(100))],  # the watermark passes requests 1 to 3
        [(1, 5, "late", True, None, at(99)), (2, 3, "late", True, None, at(98)), (9, 1, "tick", False, None, at(101))],
        [(9, 2, "end", False, None, at(140))],
    ]
    got = messages(spark, tmpdir_path, parts, watermark="10 minutes", hold="10 minutes", keep="2 hours")
    assert got == [(1, "a0 a1 a2 a3 a4 ", 5, True, False), (2, "xy", 3, False, False), (3, "pq", 2, False, True)]


def test_session_setting_is_put_back(spark):
    before = spark.conf.get(A._PROVIDER)
    with pytest.raises(KeyError):
        with A.rocksdb_state(spark):
            assert "RocksDB" in spark.conf.get(A._PROVIDER)
            raise KeyError
    assert spark.conf.get(A._PROVIDER) == before


def test_records_are_scored_once_and_replays_add_nothing(spark, tmpdir_path):
    corpus = fixtures.load(spark, SF_SMALL, "sql_corpus").select("question_id", "sql", F.col("created_at").cast("timestamp").alias("created_at"))
    for part in (corpus, corpus.where("question_id % 2 = 0")):
        part.coalesce(1).write.mode("append").json(f"{tmpdir_path}/log")
        time.sleep(1.1)
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).json(f"{tmpdir_path}/log")
    scored = ST.score_stream_once(stream, watermark="9000 days").select("question_id", "b1", "difficulty")
    ST.append_batches(scored, f"{tmpdir_path}/out", f"{tmpdir_path}/ck", trigger=None).awaitTermination()
    schema = "question_id long, b1 long, difficulty string"
    want = {tuple(r) for r in S.score_columns(corpus).select("question_id", "b1", "difficulty").collect()}
    got = [tuple(r) for r in ST.read_batches(spark, f"{tmpdir_path}/out", schema).collect()]
    assert set(got) == want and len(got) == len(want)
    first = spark.createDataFrame(spark.read.schema(schema).json(f"{tmpdir_path}/out/batch=0").collect(), schema)
    ST.write_batch(first, 0, f"{tmpdir_path}/out")  # the batch runs again
    assert ST.read_batches(spark, f"{tmpdir_path}/out", schema).count() == len(want)
    os.makedirs(f"{tmpdir_path}/out/batch=99")
    with open(f"{tmpdir_path}/out/batch=99/part-0.json", "w") as f:
        f.write('{"question_id": -1}\n')  # not whole: no marker
    assert ST.read_batches(spark, f"{tmpdir_path}/out", schema).where("question_id = -1").count() == 0


def test_nothing_written_yet(spark, tmpdir_path):
    assert ST.read_batches(spark, f"{tmpdir_path}/none", "a long").collect() == []


def test_state_calls_do_not_grow_with_the_pieces():
    from types import SimpleNamespace as NS
    from pyspark.sql import Row
    calls, kept, timers = [], [], set()
    value = {}

    def call(name, do):
        return lambda *a: calls.append(name) or do(*a)
    pieces = NS(appendList=call("append", kept.extend), get=call("pieces", lambda: iter(kept)), clear=call("drop", lambda: kept.clear()))
    request = NS(get=call("get", lambda: value.get("v")), update=call("update", lambda v: value.update(v=v)),
                 clear=call("clear", lambda: value.clear()))
    a = A._Assembler(100, 1000)
    a.init(NS(getListState=lambda *_: pieces, getValueState=lambda *_: request, registerTimer=call("timer", timers.add)))

    def clock(ms):
        return NS(getCurrentWatermarkInMs=lambda: ms)

    def rows(start, n):
        return iter([Row(seq=k, token=str(k), kind=0, ms=k) for k in range(start, start + n)])
    assert list(a.handleInputRows((1,), rows(0, 500), clock(0))) == []
    assert calls == ["get", "append", "timer", "update"] and timers == {599}
    assert list(a.handleInputRows((1,), rows(490, 60), clock(0))) == [] and timers == {599}
    assert list(a.handleExpiredTimer((1,), clock(620), NS(getExpiryTimeInMs=lambda: 599))) == [] and timers == {599, 649}
    out = list(a.handleExpiredTimer((1,), clock(700), NS(getExpiryTimeInMs=lambda: 649)))
    assert [(r.n_tokens, r.message, r.done) for r in out] == [(550, "".join(map(str, range(550))), False)]
    assert timers == {599, 649, 1649} and not kept
    assert list(a.handleInputRows((1,), rows(600, 5), clock(700))) == [] and not kept
    assert list(a.handleExpiredTimer((1,), clock(1700), NS(getExpiryTimeInMs=lambda: 1649))) == [] and not value
