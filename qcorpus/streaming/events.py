"""Event logs and token streams as Structured Streaming jobs (H1-H4).

Every function here works unchanged on a batch DataFrame and on a
streaming one (``readStream``): the batch form is what the registered
queries run, the streaming form is what a live log tail runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qcorpus.functions import scoring as S

# Wide nullable schema of the JSONL event log (one event per line).
EVENT_SCHEMA = (
    "event STRING, timestamp TIMESTAMP, item_id BIGINT, question_id BIGINT, db_id STRING, "
    "target_difficulty STRING, actual_difficulty STRING, reject_reason STRING, attempt_number INT, "
    "reward DOUBLE, bucket_freq MAP<STRING,BIGINT>, missing_buckets ARRAY<STRING>, "
    "forbidden_found ARRAY<STRING>, was_refined BOOLEAN, is_correct BOOLEAN, error STRING, "
    "sql_preview STRING, detail STRING"
)


def stream_events(spark: SparkSession, log_dir: str, schema: str = EVENT_SCHEMA,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """H1: tail an event-log directory (new JSONL files) with a fixed schema."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(log_dir)


def as_event_log(events: DataFrame) -> DataFrame:
    """The given ``events`` table in event-log form (event, timestamp)."""
    return events.select(F.col("event_type").alias("event"), F.col("ts").alias("timestamp"),
                         F.col("event_id").alias("item_id"), F.col("value").alias("reward"))


def stream_progress(events: DataFrame, interval: str = "5 seconds", watermark: str | None = "10 minutes",
                    ts_col: str = "timestamp", event_col: str = "event") -> DataFrame:
    """H2: events per type and tumbling event-time window.  With a
    watermark, a streaming query in append mode emits a window once the
    watermark passes its end; a row is dropped as late when its window's end
    is at or before the previous micro-batch's watermark (Spark's rule for
    late rows), so state stays bounded by the watermark delay."""
    df = events.withWatermark(ts_col, watermark) if watermark else events
    return df.groupBy(F.window(F.col(ts_col), interval).alias("window"), F.col(event_col).alias("event")) \
             .agg(F.count(F.lit(1)).alias("count"))


def assemble_tokens(tokens: DataFrame) -> DataFrame:
    """H3 (batch or complete-mode stream): one message per request from token
    events (request_id, seq, token, done, error).  The message is the tokens,
    which carry their own spaces, in sequence order up to and including the first closing event (``done``,
    or an ``error``, which ends the reference's token stream); ``done`` /
    ``has_error`` tell how it closed.  Requests without a closing event are
    reported open (both flags false).  A request is a bounded group (one
    generation), gathered by one shuffle."""
    kind = F.when(F.coalesce(F.col("done"), F.lit(False)), F.lit("done")) \
            .when(F.col("error").isNotNull(), F.lit("error"))
    g = tokens.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "token", kind.alias("kind")))).alias("__t"))
    first = F.array_position(F.transform("__t", lambda x: x["kind"].isNotNull()), True)
    kept = F.when(first > 0, F.slice("__t", 1, first.cast("int"))).otherwise(F.col("__t"))
    closing = F.when(first > 0, F.element_at("__t", first.cast("int"))["kind"])
    return g.select("request_id",
                    F.array_join(F.transform(kept, lambda x: x["token"]), "").alias("message"),
                    F.size(kept).cast("bigint").alias("n_tokens"),
                    F.coalesce(closing == "done", F.lit(False)).alias("done"),
                    F.coalesce(closing == "error", F.lit(False)).alias("has_error"))


ASSEMBLED_SCHEMA = "request_id long, message string, n_tokens long, done boolean, has_error boolean"


def assemble_tokens_stateful(tokens: DataFrame, timeout: str | None = None,
                             output_schema: str = ASSEMBLED_SCHEMA) -> DataFrame:
    """H3 as a custom stateful streaming operator (append mode): tokens of
    each request are kept in state until its closing event arrives, then the
    message is emitted once and the state dropped.  With ``timeout`` (e.g.
    ``"10 minutes"`` of processing time) a request idle that long is emitted
    open; note that timeouts make the engine schedule no-data micro-batches,
    so an ``availableNow`` query with open requests keeps running until they
    time out.  State per request is one generation's tokens; events of a
    request are expected in ``seq`` order across micro-batches and none after
    its closing event, as a token stream delivers them (a later event would
    open the request again)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout_ms = None
    if timeout:
        unit_ms = {"second": 1000, "minute": 60_000, "hour": 3_600_000}
        n, unit = timeout.split()
        timeout_ms = int(float(n) * unit_ms[unit.rstrip("s")])

    def out(key, toks, done, err):
        return pd.DataFrame({"request_id": [key[0]], "message": ["".join(t for t in toks if t is not None)],
                             "n_tokens": [len(toks)], "done": [done], "has_error": [err]})

    def step(key, pdfs, state):
        if state.hasTimedOut:
            toks = list(state.get[1])
            state.remove()
            yield out(key, toks, False, False)
            return
        seqs, toks = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        rows = pd.concat(list(pdfs)).sort_values("seq")
        for seq, tok, done, err in zip(rows["seq"], rows["token"], rows["done"], rows["error"]):
            seqs.append(int(seq))
            toks.append(None if pd.isna(tok) else tok)
            is_done = bool(done) if not pd.isna(done) else False
            if is_done or not pd.isna(err):
                state.remove()
                yield out(key, toks, is_done, not is_done)
                return
        state.update((seqs, toks))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    return tokens.groupBy("request_id").applyInPandasWithState(
        step, output_schema, "seqs array<long>, toks array<string>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def score_stream(records: DataFrame, sql_col: str = "sql") -> DataFrame:
    """H4: B1-B6 on arriving SQL records (a stateless projection)."""
    return S.score_columns(records, sql_col).drop("sql_clean")


def score_stream_once(records: DataFrame, id_col: str = "question_id", ts_col: str = "created_at",
                      watermark: str = "1 hour", sql_col: str = "sql") -> DataFrame:
    """H4 with every record scored once: a record that comes again within the
    watermark's delay of its first time is dropped, so state holds the ids of that
    span only.  ``records`` is a stream."""
    return score_stream(records.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([id_col]), sql_col)


def append_batches(stream: DataFrame, out_dir: str, checkpoint_location: str, trigger: str | None = "5 seconds"):
    """A8 as an idempotent sink: micro-batch n is the folder ``batch=n``, replaced
    whole, so a batch that runs again (after a failure between its write and its
    checkpoint) adds nothing.  ``trigger`` None runs ``availableNow``.  Both folders
    must be on shared storage.  Returns the StreamingQuery."""
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint_location).foreachBatch(
        lambda df, n: write_batch(df, n, out_dir))
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def write_batch(df: DataFrame, batch_id: int, out_dir: str) -> None:
    df.write.mode("overwrite").json(f"{out_dir.rstrip('/')}/batch={batch_id}")


def read_batches(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """The rows of all whole batches: folders without the marker that Spark puts
    in last are still being written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "batch=*/_SUCCESS"))
    whole = [f.getPath().getParent().toString() for f in found or []]
    return spark.read.schema(schema).json(whole) if whole else spark.createDataFrame([], schema)


def run_progress(spark: SparkSession, log_dir: str, out_dir: str, checkpoint_location: str,
                 interval: str = "5 seconds", watermark: str = "10 minutes", trigger: str | None = "5 seconds",
                 schema: str = EVENT_SCHEMA):
    """H1 + H2 as a running job: tail ``log_dir``, count events per type and
    tumbling window with a watermark, and append each closed window to a
    JSON sink.  ``trigger`` is a processing-time interval; ``None`` runs
    ``availableNow`` (process what is there, then stop).  The checkpoint
    location must be on shared storage.  Returns the StreamingQuery."""
    counts = stream_progress(stream_events(spark, log_dir, schema), interval, watermark)
    out = counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                        "event", "count")
    w = out.writeStream.outputMode("append").format("json").option("path", out_dir) \
        .option("checkpointLocation", checkpoint_location)
    w = w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)
    return w.start()
