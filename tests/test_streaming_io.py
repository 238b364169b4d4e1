"""Streaming = batch (H1, H2, H4), sources/sinks round trips (A1-A13),
execution validation (I6) and pluggable inference (I1, I5)."""

import json
import os

import pytest
import time

from pyspark.sql import functions as F

from qcorpus.functions import scoring as S
from qcorpus.operators import inference as INF
from qcorpus.operators.validate import validate_queries
from qcorpus.plans import fixtures
from qcorpus.sources import catalog as SC
from qcorpus.sources import records as RC
from qcorpus.sources import sinks as SK
from qcorpus.streaming import events as ST
from tests.conftest import SF_SMALL


def _drain(q):
    q.processAllAvailable()
    q.stop()


def test_progress_stream_equals_batch(spark, tmpdir_path):
    ev = ST.as_event_log(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    log = os.path.join(tmpdir_path, "log")
    SK.append_events(ev.select("event", "timestamp", "item_id", "reward"), log)
    stream = ST.stream_events(spark, log, "event STRING, timestamp TIMESTAMP, item_id BIGINT, reward DOUBLE",
                              max_files_per_trigger=1)
    agg = ST.stream_progress(stream, "1 hour", watermark=None)
    q = agg.writeStream.outputMode("complete").format("memory").queryName("progress_t") \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    _drain(q)
    got = spark.table("progress_t")
    batch = ST.stream_progress(spark.read.json(log, schema="event STRING, timestamp TIMESTAMP, item_id BIGINT, reward DOUBLE"),
                               "1 hour", watermark=None)
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_score_stream_equals_batch(spark, tmpdir_path):
    corpus = fixtures.load(spark, SF_SMALL, "sql_corpus")
    src = os.path.join(tmpdir_path, "corpus")
    corpus.write.json(src)
    stream = spark.readStream.schema(corpus.schema).json(src)
    scored = ST.score_stream(stream)
    q = scored.writeStream.format("memory").queryName("scored_t").outputMode("append") \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).trigger(availableNow=True).start()
    _drain(q)
    got = spark.table("scored_t").select("question_id", "b1", "b3", "b4", "difficulty")
    exp = S.score_columns(corpus).select("question_id", "b1", "b3", "b4", "difficulty")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_records_and_split_round_trip(spark, tmpdir_path):
    recs = [{"question_id": 1, "db_id": "d", "question": "q", "sql": "SELECT 1", "status": "validated"},
            {"question_id": 2, "db_id": "d", "question": "q2", "sql": "", "status": "rejected"}]
    p = os.path.join(tmpdir_path, "data.json")
    with open(p, "w") as f:
        json.dump(recs, f)
    df = RC.read_records(spark, p)
    assert df.count() == 2 and df.filter(F.col("evidence").isNull()).count() == 2
    counts = SK.write_split(df, os.path.join(tmpdir_path, "split"))
    assert counts == {"valid": 1, "rejected": 1}
    assert RC.read_jsonl(spark, os.path.join(tmpdir_path, "split/split=rejected")).count() == 1


def test_manifest_pending_registry(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "m"))
    with open(os.path.join(tmpdir_path, "m", "items.jsonl"), "w") as f:
        f.write('{"id": 1}\n{"id": 2}\n{"id": 3}\n')
    with open(os.path.join(tmpdir_path, "m", "manifest.json"), "w") as f:
        json.dump({"dev_data": "items.jsonl", "dev_db_dir": "."}, f)
    m = RC.load_manifest(spark, os.path.join(tmpdir_path, "m", "manifest.json"))
    assert m["dev_data"].count() == 3 and os.path.isdir(m["dev_db_dir"].removeprefix("file:"))
    done = spark.createDataFrame([(1, False), (2, True)], "id long, failed boolean")
    assert sorted(r.id for r in RC.pending(m["dev_data"], done, "id").collect()) == [3]
    assert sorted(r.id for r in RC.pending(m["dev_data"], done, "id", retry_failed=True).collect()) == [2, 3]
    old = spark.createDataFrame([("a", "f1"), ("b", "f2")], "name string, file_name string")
    new = spark.createDataFrame([("b", "f3")], "name string, file_name string")
    reg = {r.name: r.file_name for r in RC.upsert_registry(old, new).collect()}
    assert reg == {"a": "f1", "b": "f3"}


def test_catalog_and_descriptions(spark, tmpdir_path):
    cat = [{"db_id": "x", "table_names_original": ["a", "b c"],
            "column_names_original": [[-1, "*"], [0, "id"], [1, "a_id"], [1, "v"]],
            "primary_keys": [1, [2, 3]], "foreign_keys": [[2, 1]]}]
    p = os.path.join(tmpdir_path, "tables.json")
    with open(p, "w") as f:
        json.dump(cat, f)
    c = SC.read_catalog(spark, p)
    assert c.columns.count() == 3 and c.primary_keys.count() == 3 and c.foreign_keys.count() == 1
    from qcorpus.operators import catalog as K
    txt = K.schema_text(c).first().schema_text
    assert txt == "### Table: a\n['a.id']\n\n### Table: b c\n['`b c`.a_id', '`b c`.v']"
    d = os.path.join(tmpdir_path, "descs", "x")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w", encoding="latin-1") as f:
        f.write("original_column_name,column_description\nid,identifier é\n,\n")
    with open(os.path.join(d, "b c.csv"), "w", encoding="latin-1") as f:
        f.write("Field,Description\nv,value\n")
    descs = SC.read_column_descriptions(spark, os.path.join(tmpdir_path, "descs"))
    got = {(r.table, r.column): r.description for r in descs.collect()}
    assert got == {("a", "id"): "identifier é", ("b c", "v"): "value"}
    described = {(r.table_name, r.column_name): r.description for r in K.describe_columns(c, descs).collect()}
    assert described[("a", "id")] == "identifier é" and described[("b c", "a_id")] == ""
    by_db = {(r.table_name, r.column_name): r.description
             for r in K.describe_columns(c, descs, by_database=True).collect()}
    assert by_db[("a", "id")] == "identifier é"  # folder "x" is database "x"


def test_write_vectors_and_summary(spark, tmpdir_path):
    vec = fixtures.load(spark, SF_SMALL, "vectors")
    n = SK.write_vectors(vec, os.path.join(tmpdir_path, "vec"))
    assert n == vec.count()
    dup = vec.unionByName(vec.limit(1))
    try:
        SK.write_vectors(dup, os.path.join(tmpdir_path, "vec2"))
        raise AssertionError("duplicates accepted")
    except ValueError:
        pass
    SK.write_summary(spark.range(1).select(F.lit(3).alias("x")), os.path.join(tmpdir_path, "summary"))
    files = [f for f in os.listdir(os.path.join(tmpdir_path, "summary")) if f.endswith(".json")]
    assert len(files) == 1


def test_validate_queries(spark):
    spark.read.parquet(f"{SF_SMALL}/nation.parquet").createOrReplaceTempView("nation")
    recs = spark.createDataFrame([(1, "SELECT n_name FROM nation;"), (2, "SELECT nope FROM nation"),
                                  (3, "DROP TABLE nation"), (4, "")], "id int, sql string")
    out = {r.id: (r.status, r.validation_error, r.error_detail) for r in validate_queries(spark, recs).collect()}
    assert out[1][0] == "validated"
    assert out[2][:2] == ("rejected", "DB_ERROR") and out[2][2].sqlstate == "42703"
    assert out[3][:2] == ("rejected", "NOT_ALLOWED")
    assert out[4][:2] == ("rejected", "MISSING_FIELD")


def test_batch_generate_and_judge_with_stub(spark):
    def factory():
        def predict(prompts):
            return [{"text": "<think>ok</think>{\"is_correct\": %s, \"reasoning\": \"r\"}" %
                     ("true" if "good" in p else "false"), "prompt_tokens": len(p), "completion_tokens": 3}
                    for p in prompts]
        return predict
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, q string")
    out = INF.judge_results(df.withColumn("executed_ok", F.lit(True)), lambda d: F.concat(F.lit("judge "), "q"), factory)
    got = {r.id: (r.status, r.judge_reasoning) for r in out.collect()}
    assert got == {1: ("valid_quality", "ok"), 2: ("invalid_quality", "ok")}


def test_generate_until_class_retries_only_unresolved(spark):
    from qcorpus.operators.attempts import generate_until_class
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["simple", "aggregation", "complex", "conditional"])],
                                  "item_id long, target string")
    seen = []

    def generate(pending_df, rnd):
        seen.append((rnd, sorted(r.item_id for r in pending_df.collect())))
        # round 1 answers every item with a simple statement; round 2 answers
        # by target; later rounds would repeat round 2
        sql_by_target = F.when(F.col("target") == "aggregation", "SELECT a, COUNT(*) FROM t GROUP BY a") \
            .when(F.col("target") == "complex", "SELECT a, COUNT(*) FROM t WHERE b IN (1) GROUP BY a") \
            .when(F.col("target") == "conditional", "SELECT a FROM t WHERE b IN (1)") \
            .otherwise("SELECT a FROM t")
        sql = F.lit("SELECT a FROM t") if rnd == 1 else sql_by_target
        return pending_df.withColumn("sql", sql)

    feedback = []

    def generate_logged(pending_df, rnd):
        if rnd > 1:
            feedback.extend((r.item_id, r.missing_buckets, r.forbidden_found) for r in pending_df.collect())
        return generate(pending_df, rnd)

    out = generate_until_class(items, generate_logged, lambda d: S.score_columns(d), max_rounds=4)
    got = {r.item_id: r.attempt for r in out.collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2} and {r.outcome for r in out.collect()} == {"accepted"}
    assert seen == [(1, [0, 1, 2, 3]), (2, [1, 2, 3])]  # stops once every item is resolved
    fb = {i: (m, f) for i, m, f in feedback}
    assert fb[1] == (["B4"], []) and fb[2] == (["B3", "B4"], []) and fb[3] == (["B3"], [])


def test_correction_chain_with_stub(spark):
    def drafts():
        return lambda prompts: [{"text": "```SR\ndf1 = df.where(element = t.a)\n```"} for _ in prompts]

    def finals():
        return lambda prompts: [{"text": "```sql\nSELECT a FROM t\n```"} for _ in prompts]
    df = spark.createDataFrame([(1, "q1")], "id int, question string")
    out = INF.correction_chain(df, [
        {"prompt": lambda d: F.concat(F.lit("SR for "), "question"), "factory": drafts, "out": "sr", "dialect": "stage"},
        {"prompt": lambda d: F.concat(F.lit("SQL for "), "sr"), "factory": finals, "out": "final_sql", "dialect": "sql"},
    ]).first()
    assert out.sr == "df1 = df.where(element = t.a)" and out.final_sql == "SELECT a FROM t"


def test_stateful_token_assembly_equals_batch(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    toks = ev.select(F.floor(F.col("event_id") / 8).cast("long").alias("request_id"), F.col("event_id").alias("seq"),
                     F.col("event_type").alias("token"), (F.col("event_id") % 8 == 7).alias("done"),
                     F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))
    # a token stream sends nothing after a request's closing event
    close = toks.groupBy("request_id").agg(
        F.min(F.when(F.col("done") | F.col("error").isNotNull(), F.col("seq"))).alias("close_seq"))
    toks = toks.join(close, "request_id").filter(F.col("close_seq").isNull() | (F.col("seq") <= F.col("close_seq"))) \
               .drop("close_seq")
    src = os.path.join(tmpdir_path, "tokens")
    # three appends in sequence ranges whose borders cut through requests, so
    # open requests carry their tokens in state across micro-batches
    for lo, hi in ((0, 333), (333, 666), (666, 1 << 62)):
        toks.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").json(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(toks.schema).option("maxFilesPerTrigger", 1).json(src)
    q = ST.assemble_tokens_stateful(stream).writeStream.format("memory").queryName("assembled_t") \
        .outputMode("append").option("checkpointLocation", os.path.join(tmpdir_path, "ck3")) \
        .trigger(availableNow=True).start()
    _drain(q)
    got = spark.table("assembled_t")
    batch = ST.assemble_tokens(toks).filter(F.col("done") | F.col("has_error"))  # closed requests
    assert got.count() == batch.count()
    diff = got.exceptAll(batch)
    assert diff.count() == 0, (diff.orderBy("request_id").take(2),
                               batch.join(diff.select("request_id"), "request_id").orderBy("request_id").take(2))


def test_csv_sink_first_records_and_preview(spark, tmpdir_path):
    from qcorpus.operators.corpus import first_records
    from qcorpus.operators.validate import fetch_preview
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    first = first_records(ev, 5, "event_id")
    assert [r.event_id for r in first.collect()] == [0, 1, 2, 3, 4]
    out = os.path.join(tmpdir_path, "trials_csv")
    SK.write_csv(first.select("event_id", "value"), out, sort_cols=["value"])
    back = spark.read.option("header", True).option("inferSchema", True).csv(out)
    assert back.count() == 5 and back.columns == ["event_id", "value"]
    ev.createOrReplaceTempView("events_v")
    prev = fetch_preview(spark, "SELECT event_id, event_type FROM events_v ORDER BY event_id;", n=50)
    rows = prev.collect()
    assert len(rows) == 50 and rows[0].row.startswith('{"event_id":0')


def test_evaluate_predictions(spark):
    from qcorpus.operators.evaluate import evaluate_predictions
    df = spark.createDataFrame([(1, "```SR\ndf1 = Distinct(X)\n```", "df1 = `distinctx`"),
                                (2, "plain answer", "other words")], "id int, raw_output string, gold string")
    r = {x.id: x for x in evaluate_predictions(df).collect()}
    assert r[1].pred == "df1 = Distinct(X)" and r[1].em == 1.0   # both normalise to "df1 = distinctx"
    # tokens "df1 distinct x" vs "df1 distinctx": lcs 1, P 1/3, R 1/2, F1 0.4
    assert abs(r[1].rougeL_p - 1 / 3) < 1e-9 and abs(r[1].rougeL_r - 0.5) < 1e-9 and abs(r[1].rougeL_f1 - 0.4) < 1e-9
    assert r[2].em == 0.0 and r[2].rougeL_f1 == 0.0


def test_link_schema_whole_word(spark):
    from qcorpus.operators.linking import link_schema
    cols = spark.createDataFrame([("d", "a", "id"), ("d", "orders", "o_id")], "db_id string, table_name string, column_name string")
    texts = spark.createDataFrame([(1, "d", "SELECT o_id FROM orders"), (2, "d", "SELECT id FROM data")],
                                  "question_id int, db_id string, sql string")
    loose = {(r.question_id, r.table, r.column) for r in link_schema(texts, cols).collect()}
    strict = {(r.question_id, r.table, r.column) for r in link_schema(texts, cols, whole_word=True).collect()}
    assert (2, "a", "id") in loose                     # quirk Q14: table "a" occurs in "data"
    assert (2, "a", "id") not in strict and (1, "orders", "o_id") in strict


def test_batch_generate_timeout_gives_null(spark):
    def factory():
        import time as _t

        def predict(prompts):
            if any("slow" in p for p in prompts):
                _t.sleep(5)
            return [{"text": "ok"} for _ in prompts]
        return predict
    df = spark.createDataFrame([(1, "fast"), (2, "slow")], "id int, p string").repartition(2, "id")
    out = {r.id: r.output for r in INF.batch_generate(df, "p", factory, batch_size=1, timeout_sec=1.0).collect()}
    assert out == {1: "ok", 2: None}


def test_validate_on_sqlite(spark, tmpdir_path):
    import sqlite3
    from qcorpus.operators.validate import validate_on_sqlite
    # one small SQLite database built from given tables, copied per db_id
    base = os.path.join(tmpdir_path, "base.sqlite")
    con = sqlite3.connect(base)
    for t in ("customer", "nation", "orders"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").toPandas().to_sql(t, con, index=False)
    con.commit()
    con.close()
    corpus = fixtures.load(spark, SF_SMALL, "sql_corpus")
    dbs = [r.db_id for r in corpus.select("db_id").distinct().collect()]
    import shutil
    for d in dbs[:-1]:  # the last database has no file: DB_ERROR
        os.makedirs(os.path.join(tmpdir_path, "dbs", d))
        shutil.copy(base, os.path.join(tmpdir_path, "dbs", d, f"{d}.sqlite"))
    out = validate_on_sqlite(corpus, os.path.join(tmpdir_path, "dbs"))
    rows = out.select("question_id", "db_id", "status", "validation_error", "error_detail").collect()
    missing_db = dbs[-1]
    for r in rows:
        k = r.question_id % 8
        if r.db_id == missing_db and k != 6:
            assert r.validation_error == "DB_ERROR"
        elif k == 6:
            assert r.validation_error == "MISSING_FIELD"
        elif k in (5, 7):
            assert r.status == "rejected" and r.validation_error == "OperationalError"
            assert r.error_detail.sqlite_errorname == "SQLITE_ERROR"
        else:
            assert r.status == "validated", r


def test_validate_on_sqlite_timeout(spark, tmpdir_path):
    import sqlite3
    from qcorpus.operators.validate import validate_on_sqlite
    os.makedirs(os.path.join(tmpdir_path, "d1"))
    con = sqlite3.connect(os.path.join(tmpdir_path, "d1", "d1.sqlite"))
    con.execute("create table t(x int)")
    con.commit()
    con.close()
    slow = ("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 1000000000) "
            "SELECT count(*) FROM c")
    df = spark.createDataFrame([(1, "d1", slow), (2, "d1", "SELECT x FROM t;")], "id int, db_id string, sql string")
    got = {r.id: (r.status, r.validation_error) for r in validate_on_sqlite(df, tmpdir_path, time_limit=0.5).collect()}
    assert got == {1: ("rejected", "TIMEOUT"), 2: ("validated", None)}


def test_progress_append_mode_drops_late_rows(spark, tmpdir_path):
    log = os.path.join(tmpdir_path, "late_log")
    schema = "event STRING, timestamp TIMESTAMP"

    def write(rows):
        spark.createDataFrame(rows, "event string, ts string") \
            .select("event", F.to_timestamp("ts").alias("timestamp")).coalesce(1).write.mode("append").json(log)
        time.sleep(1.1)
    write([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 01:10:00")])
    write([("a", "2024-01-01 03:00:00")])                 # watermark moves to 02:30
    write([("a", "2024-01-01 04:00:00")])                 # [00:00, 01:00) and [01:00, 02:00) are emitted
    # late: Spark filters late rows with the previous batch's watermark
    # against the window end, so this row arrives after its window closed
    write([("a", "2024-01-01 00:30:00")])
    stream = ST.stream_events(spark, log, schema, max_files_per_trigger=1)
    agg = ST.stream_progress(stream, "1 hour", watermark="30 minutes")
    q = agg.writeStream.outputMode("append").format("memory").queryName("late_t") \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck_late")).trigger(availableNow=True).start()
    _drain(q)
    got = {(r.window.start.strftime("%H:%M"), r["count"]) for r in spark.table("late_t").collect()}
    # windows closed by the watermark (03:00 - 30 min) are emitted once; the late row is not counted
    assert got == {("00:00", 2), ("01:00", 1)}


def test_run_progress_file_sink(spark, tmpdir_path):
    log = os.path.join(tmpdir_path, "plog")
    for rows in ([("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], [("a", "2024-01-01 02:00:00")]):
        spark.createDataFrame(rows, "event string, ts string") \
            .select("event", F.to_timestamp("ts").alias("timestamp")).coalesce(1).write.mode("append").json(log)
        time.sleep(1.1)
    q = ST.run_progress(spark, log, os.path.join(tmpdir_path, "pout"), os.path.join(tmpdir_path, "pck"),
                        interval="1 hour", watermark="30 minutes", trigger=None,
                        schema="event STRING, timestamp TIMESTAMP")
    q.awaitTermination(120)
    got = {(r.event, r["count"]) for r in spark.read.json(os.path.join(tmpdir_path, "pout")).collect()}
    assert got == {("a", 1), ("b", 1)}  # the 00:00 window closed; 02:00 still open


def test_write_split_single_pass(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "validated"), (2, "rejected"), (3, None)], "id int, status string")
    counts = SK.write_split(df, os.path.join(tmpdir_path, "split"))
    assert counts == {"valid": 1, "rejected": 2}
    back = spark.read.json(os.path.join(tmpdir_path, "split"))
    assert {(r.id, r.split) for r in back.collect()} == {(1, "valid"), (2, "rejected"), (3, "rejected")}


def test_generate_until_class_returns_every_item(spark):
    from qcorpus.operators.attempts import generate_until_class
    items = spark.createDataFrame([(0, "simple"), (1, "aggregation"), (2, "simple")], "item_id long, target string")
    calls = []

    def generate(pending_df, rnd):
        calls.append(sorted(r.item_id for r in pending_df.collect()))
        # item 1 is always wrong, item 2 gets no row in the first two rounds
        return pending_df.where(f"item_id <> 2 or {rnd} > 2").withColumn("sql", F.lit("SELECT a FROM t"))
    out = generate_until_class(items, generate, lambda d: S.score_columns(d), max_rounds=2).collect()
    assert {(r.item_id, r.outcome) for r in out} == {(0, "accepted"), (1, "max_retry_exhausted"), (2, "max_retry_exhausted")}
    assert calls == [[0, 1, 2], [1, 2]]
    none = generate_until_class(items.limit(0), lambda d, r: d.withColumn("sql", F.lit("x")), lambda d: S.score_columns(d))
    assert none.collect() == [] and "outcome" in none.columns


def test_one_hung_or_failing_prompt_costs_only_its_rows(spark):
    def factory():
        def predict(prompts):
            import time
            if "hang" in prompts:
                time.sleep(4)
            if "fail" in prompts:
                raise ValueError("no")
            return [{"text": p.upper()} for p in prompts]
        return predict
    rows = ["a", "hang", "b", "c", "fail", "d", "e", "f"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, prompt string").coalesce(1)
    got = {r.id: (r.output, r.generation_error) for r in
           INF.batch_generate(df, "prompt", factory, batch_size=2, timeout_sec=1.0).collect()}
    assert got[0] == got[1] == (None, "timeout")
    assert got[4] == (None, "ValueError: no") and got[5] == ("D", None)
    assert [got[k][0] for k in (2, 3, 6, 7)] == ["B", "C", "E", "F"]


def test_descriptions_with_quotes_and_line_breaks(spark, tmpdir_path):
    from qcorpus.sources.catalog import read_column_descriptions
    folder = os.path.join(tmpdir_path, "db1", "database_description")
    os.makedirs(folder)
    cells = [("a", 'says "hi, you" ok'), ("b", "line one\nline two"), ("c", "caf\xe9, plain"), ("d", "")]
    import csv
    with open(os.path.join(folder, "t.csv"), "w", encoding="latin-1", newline="") as f:
        w = csv.writer(f)
        w.writerow(["original_column_name", "column, extra", "column_description"])
        w.writerows((c, "x", d) for c, d in cells)
    got = {(r.column, r.description) for r in read_column_descriptions(spark, tmpdir_path).collect()}
    assert got == set(cells)


def test_failed_replacement_keeps_the_old_collection(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "vectors")
    assert SK.write_vectors(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path) == 2
    with pytest.raises(ValueError):
        SK.write_vectors(spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string"), path)
    assert spark.read.parquet(path).count() == 2


def test_evaluation_with_embedding_score_and_means(spark):
    from qcorpus.operators import evaluate as EV
    df = spark.createDataFrame([(1, "```SR\na b\n```", "a b"), (2, "", "c d")], "id long, raw_output string, gold string")
    tokens = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 0, [1.0, 0.0]), (2, 1, 0, [0.0, 1.0])],
                                   "id long, side int, pos int, embedding array<double>")
    out = EV.evaluate_predictions(df, tokens=tokens)
    got = {r.id: (r.em, r.rougeL_f1, r.bert_f1) for r in out.collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}
    mean = EV.evaluation_means(out).first()
    assert mean["n"] == 2 and mean["mean_em"] == 0.5 and mean["mean_bert_f1"] == 0.5


def test_answers_go_on_call_by_call():
    """One Arrow batch of 40 prompts: a row is passed on before the next call is made."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    calls = []

    class Rows:
        schema = StructType([StructField("id", LongType()), StructField("p", StringType())])
        columns = ["id", "p"]

        def mapInArrow(self, run, schema):
            return run

    def factory():
        return lambda prompts: calls.append(list(prompts)) or [{"text": p.upper(), "prompt_tokens": len(p)} for p in prompts]
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "p": [None if k == 3 else f"p{k}" for k in range(40)]})
    run = INF.batch_generate(Rows(), "p", factory, batch_size=16)(iter([batch]))
    first = next(run)
    assert [len(c) for c in calls] == [16] and first.num_rows == 16
    rows = pa.Table.from_batches([first, *run]).to_pylist()
    assert [len(c) for c in calls] == [16, 16, 8] and [r["id"] for r in rows] == list(range(40))
    assert rows[3] == {"id": 3, "p": None, "output": "", "prompt_tokens": 0, "completion_tokens": None, "generation_error": None}
    assert rows[39]["output"] == "P39"
