"""Offline corpus build on Spark, end to end, with a stub model.

catalog -> schema graph -> random walks -> prompt budget -> prompts ->
retry loop (generate, score, feed back) -> execution validation -> judge ->
indexable rows -> embeddings -> vector collection + build summary.

The model is a deterministic stub so the example runs anywhere; pass any
factory with the same contract (``predict(list[str]) -> list[dict]``) to use
a real one.  Usage: python examples/offline_build.py [sf_dir] [out_dir]
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from qcorpus.functions import scoring as S  # noqa: E402
from qcorpus.functions.prompts import class_rules, render_template  # noqa: E402
from qcorpus.functions.text import parse_json_object  # noqa: E402
from qcorpus.operators import catalog as K  # noqa: E402
from qcorpus.operators import corpus as C  # noqa: E402
from qcorpus.operators import vectors as V  # noqa: E402
from qcorpus.operators import walks as W  # noqa: E402
from qcorpus.operators.attempts import generate_until_class  # noqa: E402
from qcorpus.operators.inference import batch_generate, judge_results  # noqa: E402
from qcorpus.operators.validate import validate_queries  # noqa: E402
from qcorpus.plans import fixtures  # noqa: E402
from qcorpus.session import local_session, table  # noqa: E402
from qcorpus.sources import sinks  # noqa: E402
from qcorpus.sources.catalog import flatten_catalog  # noqa: E402

RULES = {"simple": "one table", "conditional": "a filter by cases", "aggregation": "a grouped total",
         "complex": "a grouped total over a filter by cases"}
STUB_SQL = {
    "simple": "SELECT c_name FROM customer WHERE c_acctbal > 100",
    "conditional": "SELECT c_name FROM customer WHERE c_mktsegment IN ('BUILDING')",
    "aggregation": "SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey",
    "complex": "SELECT c_nationkey, COUNT(*) FROM customer WHERE c_mktsegment LIKE 'B%' GROUP BY c_nationkey",
}


def stub_generator():
    """A stand-in model: first attempts answer 'simple', refinements answer the target."""
    import json

    def predict(prompts):
        out = []
        for p in prompts:
            target = p.split("Target class: ")[1].split("\n")[0]
            attempt = int(p.split("Attempt: ")[1].split("\n")[0])
            sql = STUB_SQL["simple"] if attempt == 1 else STUB_SQL[target]
            out.append({"text": "<think>plan</think>" + json.dumps({"question": f"Q for {target}", "sql": sql}),
                        "prompt_tokens": len(p.split()), "completion_tokens": 20})
        return out
    return predict


def stub_judge():
    def predict(prompts):
        return [{"text": '{"is_correct": %s, "reasoning": "checked"}' % ("true" if "COUNT" not in p else "false")}
                for p in prompts]
    return predict


def main(sf_dir="/root/testdata/sf0.001", out_dir=None):
    spark = local_session(4)
    out_dir = out_dir or tempfile.mkdtemp(prefix="qcorpus-build-")
    cat = flatten_catalog(fixtures.load(spark, sf_dir, "catalog"))
    # one item per database in turn, classes by neediest-first quotas (here: round robin on item id)
    dbs = cat.tables.select("db_id").distinct()
    items = spark.range(0, 40).withColumnRenamed("id", "item_id")
    items = W.assign_round_robin(items, "item_id", dbs, "db_id")
    k = F.col("item_id") % 4
    items = items.withColumn("target", F.when(k == 0, "simple").when(k == 1, "conditional")
                             .when(k == 2, "aggregation").otherwise("complex"))
    walks = W.random_walks(items.select(F.col("item_id").alias("walk_id"), "db_id"), cat.tables, K.fk_edges(cat))
    descs = W.table_descriptions(K.describe_columns(cat, spark.createDataFrame([], "table string, column string, description string")), cat.tables)
    context = W.pack_budget(walks, descs).withColumnRenamed("walk_id", "item_id")
    items = items.join(context, "item_id", "left").withColumn("context", F.coalesce("context", F.lit("")))

    template = "Schema:\n{context}\nTarget class: {target}\nRules: {rules}\nAttempt: {attempt}\nMissing: {missing}\n"

    def generate(pending, rnd):
        missing = F.array_join("missing_buckets", ",") if "missing_buckets" in pending.columns else F.lit("")
        p = pending.withColumn("prompt", render_template(template, context="context", target="target",
                                                         rules=class_rules("target", RULES),
                                                         attempt=F.lit(str(rnd)), missing=missing))
        g = batch_generate(p.select("item_id", "db_id", "target", "context", "prompt"), "prompt", stub_generator)
        parsed = parse_json_object(F.col("output"), "struct<question:string, sql:string>")
        return g.select("item_id", "db_id", "target", "context", parsed["question"].alias("question"),
                        parsed["sql"].alias("sql"))

    accepted = generate_until_class(items, generate, lambda d: S.score_columns(d)).where("outcome = 'accepted'")
    corpus = accepted.select(F.col("item_id").alias("question_id"), "db_id", "question", "sql", "difficulty",
                             F.col("attempt").alias("gen_attempts"), (F.col("attempt") > 1).alias("was_refined"))
    # execution validation against the given tables as views
    for t in ("customer", "nation", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    validated = validate_queries(spark, corpus)
    counts = sinks.write_split(validated, os.path.join(out_dir, "split"))
    judged = judge_results(validated.withColumn("executed_ok", F.col("status") == "validated"),
                           lambda d: F.concat(F.lit("Question: "), F.col("question"), F.lit("\nSQL: "), F.col("sql")),
                           stub_judge, executed_col="executed_ok")
    kept = C.select_indexable(judged)
    vectors = V.batch_embed(kept, "document").select("id", "document", "embedding", "metadata")
    n = sinks.write_vectors(vectors, os.path.join(out_dir, "vectors"))
    summary = C.build_summary(judged, spark.read.parquet(os.path.join(out_dir, "vectors")))
    sinks.write_summary(summary, os.path.join(out_dir, "summary"))
    print({"accepted": corpus.count(), "split": counts, "indexed": n, "out": out_dir})
    return n


if __name__ == "__main__":
    main(*sys.argv[1:])
