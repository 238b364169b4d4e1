"""Online question -> SQL and evaluation on Spark, with a stub model.

questions -> nearest stored examples (exact top-k over the vector collection) ->
example block with fallback -> prompt with schema text -> staged stub model
(draft SR, final SQL) -> SQL extraction -> scorer tag -> resume bookkeeping ->
exact match + ROUGE-L against gold -> metric summary and latency summary.

Usage: python examples/online_eval.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from qcorpus.functions.prompts import render_template  # noqa: E402
from qcorpus.functions.status import tag_prediction  # noqa: E402
from qcorpus.operators import catalog as K  # noqa: E402
from qcorpus.operators import evaluate as EV  # noqa: E402
from qcorpus.operators import vectors as V  # noqa: E402
from qcorpus.operators.inference import correction_chain  # noqa: E402
from qcorpus.plans import fixtures  # noqa: E402
from qcorpus.session import local_session  # noqa: E402
from qcorpus.sources.catalog import flatten_catalog  # noqa: E402
from qcorpus.sources.records import pending  # noqa: E402


def stub_sr():
    return lambda prompts: [{"text": "```SR\ndf1 = df.where(element = orders.o_orderkey)\n```"} for _ in prompts]


def stub_sql():
    def predict(prompts):
        return [{"text": "```sql\nSELECT o_totalprice FROM orders WHERE o_orderkey = %s\n```"
                 % p.rsplit("order ", 1)[-1].split("?")[0]} for p in prompts]
    return predict


def main(sf_dir="/root/testdata/sf0.001"):
    spark = local_session(4)
    corpus = fixtures.load(spark, sf_dir, "sql_corpus")
    questions = corpus.filter(F.col("sql").startswith("SELECT o_totalprice")) \
        .select("question_id", "db_id", "question", F.col("sql").alias("gold"))
    # retrieval: question embeddings (hashing encoder) against stored examples
    store = V.batch_embed(corpus.select(F.col("question_id").alias("id"), "question", "sql"), "question")
    qv = V.batch_embed(questions.select(F.col("question_id").alias("query_id"), "question"), "question")
    hits = V.top_k_similar(qv, store, k=3, exclude_self=True)
    meta = store.select("id", F.col("id").alias("source_id"), "question", "sql")
    examples = V.retrieve_examples(hits, meta, qv).withColumnRenamed("query_id", "question_id")
    schemas = K.schema_text(flatten_catalog(fixtures.load(spark, sf_dir, "catalog")))
    items = K.attach_schema(questions, schemas).join(examples, "question_id", "left")
    # resume: nothing done yet in this run
    done = spark.createDataFrame([], "question_id long")
    items = pending(items, done, "question_id")
    stages = [
        {"prompt": lambda d: render_template("{schema}\n{ex}\nQuestion: {q}", schema="schema_text", ex="examples",
                                             q="question"),
         "factory": stub_sr, "out": "sr", "dialect": "stage"},
        {"prompt": lambda d: render_template("SR: {sr}\nQuestion: {q}", sr="sr", q="question"),
         "factory": stub_sql, "out": "pred", "dialect": "sql"},
    ]
    out = correction_chain(items, stages)
    out = out.withColumn("tagged", tag_prediction("pred", "db_id")) \
             .withColumn("latency", F.lit(0.01) + (F.col("question_id") % 7) / 100.0)
    scores = EV.evaluate_predictions(out.withColumnRenamed("pred", "raw"), raw_col="raw", gold_col="gold",
                                     id_col="question_id", dialect="sql")
    scores = scores.withColumn("module", F.lit("online"))
    summary = EV.metric_summary(scores, ["module"], ["em", "rougeL_f1"])
    lat = EV.latency_summary(out, "latency")
    s, l = summary.first(), lat.first()
    print({"questions": s["n"], "mean_em": s["mean_em"], "mean_rougeL_f1": s["mean_rougeL_f1"], "latency_n": l["n"]})
    return s


if __name__ == "__main__":
    main(*sys.argv[1:])
