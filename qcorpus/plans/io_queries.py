"""Registered queries that write with a sink below the shared checkpoint
folder and read back, and the stream jobs run on stored events (A2, A7, A9,
A10, A12, A13, D8, H1, H2, H4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qcorpus.plans import fixtures, sqlgen
from qcorpus.plans.registry import register
from qcorpus.session import checkpoint_dir, table
from qcorpus.sources import json_array as JA
from qcorpus.sources import records as RC
from qcorpus.sources import sinks as SK
from qcorpus.streaming import assembly as AS
from qcorpus.streaming import events as ST

CORPUS = f"sql_corpus as ({fixtures.SQL_CORPUS_SQL})"


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("split_round_trip", "A2 A7", sql=f"""
with {CORPUS}
select question_id, db_id, sql, case when status = 'valid_quality' then 'valid' else 'rejected' end as split
from sql_corpus""")
def split_round_trip(spark, sf_dir):
    c = fixtures.load(spark, sf_dir, "sql_corpus").select("question_id", "db_id", "sql", "status")
    path = _folder(spark, "split")
    SK.write_split(c, path, valid_status="valid_quality")
    return RC.read_jsonl(spark, path, "question_id long, db_id string, sql string, split string")


@register("json_array_round_trip", "A1", sql="""
select doc_id, lang, n_chars, md5(text) as text_md5 from documents""")
def json_array_round_trip(spark, sf_dir):
    """Whole documents written as JSON arrays, read back by ranges of 1 MiB."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    path = _folder(spark, "arrays")
    JA.write_json_array(docs.withColumn("part", F.floor(F.col("doc_id") / 500)), path, "part", "doc_id")
    rows = JA.read_json_array(spark, path, "doc_id long, lang string, n_chars int, text string", range_bytes=1 << 20)
    n_chars = F.col("n_chars").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select("doc_id", "lang", n_chars, F.md5("text").alias("text_md5"))


@register("csv_round_trip", "A9", sql="""
select o_orderkey, o_orderstatus, o_orderpriority from orders""")
def csv_round_trip(spark, sf_dir):
    path = _folder(spark, "csv")
    SK.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_orderpriority string").csv(path)


@register("registry_upsert", "A10", sql="""
select c_name as name, case when c_custkey % 3 = 0 then c_nationkey + 100 else c_nationkey end as version
from customer where c_custkey % 5 <> 0 or c_custkey % 3 = 0""")
def registry_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = _folder(spark, "registry")
    version = F.col("c_nationkey")
    SK.write_registry(c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("name"), version.alias("version")), path)
    new = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), (version + 100).alias("version"))
    schema = "name string, version int"
    SK.write_registry(RC.upsert_registry(RC.read_jsonl(spark, path, schema), new), path)
    return RC.read_jsonl(spark, path, schema)


@register("vector_store", "A12 D8", sql="""
select vec_id as id, cast(len(embedding) as bigint) as dim, round(embedding[1], 6) as first from embeddings""")
def vector_store(spark, sf_dir):
    v = fixtures.load(spark, sf_dir, "vectors").select("id", "embedding")
    path = _folder(spark, "vectors")
    SK.write_vector_version(v.where("id % 2 = 0"), path)
    first = SK.read_vector_version(spark, path).select("id")
    SK.write_vector_version(v, path)  # readers of the first version keep it
    whole = SK.read_vector_version(spark, path).where("id % 2 <> 0").unionByName(
        SK.read_vector_version(spark, path).join(first, "id", "left_semi"))
    return whole.select("id", F.size("embedding").cast("bigint").alias("dim"),
                                           F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("summary_document", "A13", sql="""
select count(*) as n, count(distinct lang) as langs, cast(sum(n_chars) as bigint) as chars from documents""")
def summary_document(spark, sf_dir):
    path = _folder(spark, "summary")
    SK.write_summary(table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("n long, langs long, chars long").json(path)


@register("stream_windows", "H1 H2", sql="""
with w as (select time_bucket(interval '1 hour', ts) as s, event_type as event, count(*) as count from events group by 1, 2)
select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, event, count from w
where s + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def stream_windows(spark, sf_dir):
    """The running progress job over a stored event log: closed windows only."""
    log, out = _folder(spark, "events"), _folder(spark, "windows")
    SK.append_events(ST.as_event_log(table(spark, sf_dir, "events")).select("event", "timestamp"), log)
    q = ST.run_progress(spark, log, out, _folder(spark, "progress"), interval="1 hour", watermark="10 minutes", trigger=None,
                        schema="event string, timestamp timestamp")
    q.awaitTermination()
    return spark.read.schema("window_start timestamp, event string, count long").json(out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event", "count")


@register("scored_stream", "H4 A8", sql=f"""
with {sqlgen.scored_corpus_ctes()}
select question_id, b1, b3, b4, round(reward, 6) as reward, difficulty from scored""")
def scored_stream(spark, sf_dir):
    """The corpus as a log in three parts; a third of the records come again in
    the next part.  Scored once each, into a sink by micro-batch."""
    corpus = fixtures.load(spark, sf_dir, "sql_corpus").select("question_id", "sql", F.col("created_at").cast("timestamp")
                                                               .alias("created_at"))
    log, out = _folder(spark, "log"), _folder(spark, "scored")
    part = F.col("question_id") % 3
    for n in range(3):
        again = (part == n - 1) & (F.col("question_id") % 9 < 3)
        SK.append_events(corpus.where((part == n) | again), log)
    stream = spark.readStream.schema(corpus.schema).json(log)
    once = ST.score_stream_once(stream, watermark="4000 days")
    ST.append_batches(once.select("question_id", "b1", "b3", "b4", F.round("reward", 6).alias("reward"), "difficulty"), out,
                      _folder(spark, "scoring"), trigger=None).awaitTermination()
    return ST.read_batches(spark, out, "question_id long, b1 long, b3 long, b4 long, reward double, difficulty string")


@register("stream_assembly", "H3", sql="""
with t as (select event_id // 8 as request_id, event_id as seq, ts, case when event_id % 8 = 0 then '' else ' ' end || event_type as token,
                  event_id % 8 = 7 as done, event_type = 'error' as err from events),
c as (select request_id, min(case when done or err then seq end) as close_seq, max(ts) as last from t group by 1)
select t.request_id, string_agg(token, '' order by seq) as message, count(*) as n_tokens,
  coalesce(bool_or(seq = close_seq and done), false) as done,
  coalesce(bool_or(seq = close_seq and err and not done), false) as has_error
from t join c on t.request_id = c.request_id
where (close_seq is null or seq <= close_seq) and last <= (select max(ts) from events) - interval 2 day group by 1""")
def stream_assembly(spark, sf_dir):
    """Pieces that arrive up to a day late, in five parts that cut through the
    requests: those that the watermark has closed at the end of the log.  The
    stream goes on from its checkpoint after every part, a part being one
    micro-batch of however many files."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    toks = ev.select(F.floor(F.col("event_id") / 8).cast("bigint").alias("request_id"), F.col("event_id").alias("seq"),
                     F.concat(F.when(F.col("event_id") % 8 == 0, "").otherwise(" "), "event_type").alias("token"),
                     (F.col("event_id") % 8 == 7).alias("done"), F.when(F.col("event_type") == "error", F.lit("error")).alias("error"),
                     F.col("ts").alias("timestamp"))
    log = _folder(spark, "pieces")
    late = F.pmod(F.xxhash64("seq"), F.lit(86_000))  # seconds
    ends = ev.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    first, last = ends[0] or 0, ends[1] or 0
    part = F.least(F.lit(4), F.floor((F.unix_seconds("timestamp") + late - first) * 5 / (last - first + 1)))
    path, progress = _folder(spark, "messages"), _folder(spark, "assembly")
    for n in range(5):
        SK.append_events(toks.where(part == n), log)
        stream = spark.readStream.schema(toks.schema).json(log)
        out = AS.assemble_tokens_ordered(stream, watermark="1 day", hold="1 day", keep="1 day")
        with AS.rocksdb_state(spark):
            out.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress) \
                .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
