"""Registered queries around a predictor, whose answers are the recorded model
outputs (I1, I3, I5, I8), and round trips of the user's files (A3, A6, F4)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from qcorpus.operators import evaluate as EV
from qcorpus.operators import inference as INF
from qcorpus.operators.validate import fetch_preview
from qcorpus.plans import eval_queries as EQ
from qcorpus.plans import fixtures
from qcorpus.plans import text_queries as TQ
from qcorpus.plans.io_queries import _folder
from qcorpus.plans.registry import register
from qcorpus.session import spread, table
from qcorpus.sources import catalog as CT
from qcorpus.sources import records as RC


def recorded():
    """A predictor that answers with the recorded output it is handed."""
    return lambda prompts: [{"text": p} for p in prompts]


def digests():
    """A predictor whose answer is the MD5 of the prompt."""
    import hashlib
    return lambda prompts: [{"text": hashlib.md5(p.encode()).hexdigest(), "prompt_tokens": len(p)} for p in prompts]


@register("logged_generation", "I1 I4", sql="""
select doc_id, md5(concat('Summarise: ', text)) as output, length(concat('Summarise: ', text)) as prompt_tokens from documents""")
def logged_generation(spark, sf_dir):
    """Half of the prompts first, then all of them: the second run finds the
    first one's calls in the log."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Summarise: "), "text").alias("prompt")))
    log = _folder(spark, "calls")

    def run(rows):
        return INF.logged_generate(rows, "prompt", digests, log, "digest-1", batch_size=256, shards=32)
    run(docs.where("doc_id % 2 = 0")).write.format("noop").mode("overwrite").save()
    return run(docs).select("doc_id", "output", "prompt_tokens")


REASONING = TQ.strip("regexp_extract(output, '(?s)<think>(.*?)</think>', 1)")
CONTENT = TQ.strip("replace(case when instr(output, '</think>') > 0 then " + TQ.strip("split_part(output, '</think>', 2)")
                   + " else output end, '<|im_end|>', '')")


@register("judged_answers", "I5", sql=f"""
with {TQ.MO},
c as (select doc_id, case when regexp_matches(output, '(?s)<think>(.*?)</think>') then {REASONING} else '' end as judge_reasoning,
             {CONTENT} as output from model_outputs),
j as (select doc_id, judge_reasoning, case when regexp_matches({TQ.JSON_TEXT_SQL}, '(?s)\\{{.*\\}}')
             then regexp_extract({TQ.JSON_TEXT_SQL}, '(?s)(\\{{.*\\}})', 1) end as found from c),
p as (select doc_id, judge_reasoning, case when json_valid(found) then found end as ok from j),
v as (select doc_id, judge_reasoning, ok, cast(json_extract(ok, '$.is_correct') as boolean) as is_correct,
             json_extract(ok, '$.is_correct') is null or json_extract(ok, '$.reasoning') is null as incomplete from p)
select doc_id, judge_reasoning, is_correct,
  case when doc_id % 11 = 0 then 'execution_failed' when ok is null or incomplete then 'judge_failed'
       when is_correct then 'valid_quality' else 'invalid_quality' end as status,
  case when doc_id % 11 = 0 then null when ok is null then 'generation_failed'
       when incomplete then 'invalid_output_format' end as judge_error
from v""")
def judged_answers(spark, sf_dir):
    rows = spread(fixtures.load(spark, sf_dir, "model_outputs")).withColumn("executed_ok", F.col("doc_id") % 11 != 0)
    judged = INF.judge_results(rows, lambda df: F.col("output"), recorded)
    return judged.select("doc_id", "judge_reasoning", "is_correct", "status", "judge_error")


@register("corrected_answers", "I3", sql=f"""
with {TQ.MO},
s as (select doc_id, {TQ.STAGE_SQL} as sr from model_outputs),
t as (select doc_id, sr, concat('{TQ.F3}sql', chr(10), sr, chr(10), '{TQ.F3}') as output from s)
select doc_id, sr, {TQ.SQL_SQL} as final_sql from t""")
def corrected_answers(spark, sf_dir):
    rows = spread(fixtures.load(spark, sf_dir, "model_outputs").select("doc_id", "output"))
    fence = TQ.F3
    out = INF.correction_chain(rows, [
        {"prompt": lambda df: F.col("output"), "factory": recorded, "out": "sr", "dialect": "stage"},
        {"prompt": lambda df: F.concat(F.lit(f"{fence}sql\n"), "sr", F.lit(f"\n{fence}")), "factory": recorded,
         "out": "final_sql", "dialect": "sql"}])
    return out.select("doc_id", "sr", "final_sql")


@register("evaluated_answers", "I8 I7 C12 B16", sql=f"""
with sql_pairs as ({fixtures.SQL_PAIRS_SQL}),
{EQ.ROUGE_SQL},
match as ({EQ.GREEDY_SQL})
select s.pair_id, s.pred, cast({EQ.EM} as double) as em, rougeL_p, rougeL_r, rougeL_f1, coalesce(bert_precision, 0) as bert_precision,
  coalesce(bert_recall, 0) as bert_recall, coalesce(bert_f1, 0) as bert_f1
from sql_pairs s join rouge r using (pair_id) left join match m using (pair_id)""")
def evaluated_answers(spark, sf_dir):
    """Every score of an evaluation from the raw answers; the token vectors of
    the first pairs are the given embeddings."""
    pairs = fixtures.load(spark, sf_dir, "sql_pairs")
    raw = pairs.select("pair_id", F.concat(F.lit(TQ.F3 + "SR\n"), "pred", F.lit("\n" + TQ.F3)).alias("raw_output"), "gold")
    scores = EV.evaluate_predictions(raw, id_col="pair_id", tokens=EQ.pair_tokens(spark, sf_dir))
    kept = [F.round(c, 6).alias(c) for c in ("bert_precision", "bert_recall", "bert_f1")]
    return scores.select("pair_id", "pred", "em", "rougeL_p", "rougeL_r", "rougeL_f1", *kept)


@register("column_descriptions", "A3", sql="""
select concat('db=', cast(c_nationkey as varchar)) as db_folder, c_name as column,
  case when c_custkey % 10 = 0 then '' else concat('Segment "', c_mktsegment, '", caf', chr(233), chr(10), 'row ', cast(c_custkey as varchar)) end as description
from customer where c_custkey % 17 <> 0""")
def column_descriptions(spark, sf_dir):
    """Description files of two layouts in a folder per nation, with quotes and
    line breaks inside cells, written in Latin-1 and read back."""
    key = F.col("c_custkey")
    text = F.concat(F.lit('Segment "'), "c_mktsegment", F.lit('", café\nrow '), key.cast("string"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("db"), key, F.when(key % 17 == 0, "").otherwise(F.col("c_name")).alias("column"),
        F.when(key % 10 == 0, "").otherwise(text).alias("description"))
    root = _folder(spark, "descriptions")
    for n, names in enumerate((("original_column_name", "column_description"), ("Field", "Description"))):
        part = rows.where(key % 2 == n).select("db", F.col("column").alias(names[0]), F.col("description").alias(names[1]))
        part.repartition("db").write.mode("append").partitionBy("db").option("header", True).option("escape", '"') \
            .option("encoding", "ISO-8859-1").csv(root)
    return CT.read_column_descriptions(spark, root).select("db_folder", "column", "description")


@register("manifest_records", "A6", sql="""
select 'orders' as entry, cast(o_orderkey as bigint) as id, o_orderstatus as value from orders
union all select 'vectors', cast(vec_id as bigint), cast(label as varchar) from embeddings""")
def manifest_records(spark, sf_dir):
    """A manifest with a JSON Lines entry and a folder, resolved from the manifest's place."""
    root = _folder(spark, "manifest")
    orders, vectors = table(spark, sf_dir, "orders"), table(spark, sf_dir, "embeddings")
    orders.select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderstatus").alias("value")).write.json(f"{root}/orders.jsonl")
    vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("string").alias("value")).write.parquet(f"{root}/vectors")
    spec = json.dumps({"orders": "orders.jsonl", "vectors": "vectors"})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{root}/manifest.json")
    entries = RC.load_manifest(spark, f"{root}/manifest.json",
                               readers={"orders": lambda s, p: RC.read_jsonl(s, p, "id bigint, value string")})
    rows = entries["orders"].select(F.lit("orders").alias("entry"), "id", "value")
    return rows.unionByName(spark.read.parquet(entries["vectors"]).select(F.lit("vectors").alias("entry"), "id", "value"))


@register("statement_previews", "F4", sql="""
(select 'orders' as source, concat('{"o_orderkey":', cast(o_orderkey as varchar), ',"o_orderstatus":"', o_orderstatus, '"}') as row
 from orders order by o_orderkey desc limit 50)
union all
(select 'customer', concat('{"c_mktsegment":"', c_mktsegment, '","n":', cast(count(*) as varchar), '}')
 from customer group by c_mktsegment order by c_mktsegment limit 50)""")
def statement_previews(spark, sf_dir):
    """The first 50 result rows of two statements on registered views."""
    def preview(name, sql):
        view = f"{name}_{uuid.uuid4().hex}"
        table(spark, sf_dir, name).createOrReplaceTempView(view)
        return fetch_preview(spark, sql.format(view)).select(F.lit(name).alias("source"), "row")
    return preview("orders", "select o_orderkey, o_orderstatus from {} order by o_orderkey desc; ").unionByName(
        preview("customer", "select c_mktsegment, count(*) as n from {} group by c_mktsegment order by c_mktsegment"))
