"""Registered queries: schema masking and filling, prompt rendering,
prediction tagging, event-log projection and resume (B19-B21, B25, A8, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qcorpus.functions import text as T
from qcorpus.functions.prompts import class_rules, render_template
from qcorpus.functions.status import tag_prediction
from qcorpus.operators import catalog as K
from qcorpus.plans import fixtures
from qcorpus.plans.registry import register
from qcorpus.sources.records import pending
from qcorpus.sources.sinks import to_events

MO = f"model_outputs as ({fixtures.MODEL_OUTPUTS_SQL})"
CORPUS = f"sql_corpus as ({fixtures.SQL_CORPUS_SQL})"


def _names(kind):
    """``table.column`` names that a database of a kind (its number modulo 3) has
    besides those of a third of its tables, longest first, ties by name."""
    more = fixtures.catalog_extras().get(kind)
    tables = fixtures.CATALOG_TABLES + ([(more["table_names_original"][0], [c for _, c in more["column_names_original"]])] if more else [])
    names = [f"{t}.{c}" for t, cs in tables for c in cs if (len(t) + kind) % 3 != 0]
    return sorted(names, key=lambda n: (-len(n), n))


def _mask_sql(x, kind):
    for n in _names(kind):
        x = f"replace({x}, '{n}', '[MASK]')"
    return x


NAMED_IN_ANSWERS = " ordered by orders.o_orderkey, nation.n_name and events.event_id, with documents.text of labels.doc_id"


@register("mask_and_fill", "B19 B20", sql=f"""
with {MO},
d as (select doc_id, doc_id % (select count(distinct o_custkey // 10) from orders) % 3 as kind,
  case when doc_id % 2 = 0 then concat(output, '{NAMED_IN_ANSWERS}') else output end as output from model_outputs),
m as (select doc_id, kind, case kind {" ".join(f"when {k} then {_mask_sql('output', k)}" for k in range(3))} end as masked from d),
f as (select doc_id, kind, masked, string_split(masked, '[MASK]') as parts from m),
fills as (select kind, list(n order by n) as fl
  from (values {", ".join(f"({k}, '{n}')" for k in range(3) for n in _names(k))}) as t(kind, n) group by 1)
select doc_id, md5(masked) as masked_md5, cast(len(parts) - 1 as bigint) as n_masks,
  md5(array_to_string(list_transform(parts, lambda p, i: case when i < len(parts)
        then concat(p, coalesce(fl[i], '[MASK]')) else p end), '')) as filled_md5
from f join fills using (kind)""")
def mask_and_fill(spark, sf_dir):
    """Documents dealt to all databases, whose names differ; several names a text."""
    from qcorpus.plans.catalog_queries import catalog
    named = K.named_columns(catalog(spark, sf_dir))
    number = F.regexp_extract("db_id", r"(\d+)$", 1).cast("long")
    named = named.where((F.length("table_name") + number) % 3 != 0)
    names = named.groupBy("db_id").agg(F.collect_list(F.concat_ws(".", "table_name", "column_name")).alias("names"))
    answers = fixtures.load(spark, sf_dir, "model_outputs").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("output", F.lit(NAMED_IN_ANSWERS))).otherwise(F.col("output"))
        .alias("output"), F.concat(F.lit("db_"), (F.col("doc_id") % names.agg(F.count(F.lit(1))).scalar()).cast("string"))
        .alias("db_id"))
    j = answers.join(names, "db_id", "left")  # one row per database
    out = j.withColumn("masked", T.mask_schema("output", F.col("names")))
    filled = T.fill_masks("masked", F.array_sort("names"))
    return out.select("doc_id", F.md5("masked").alias("masked_md5"),
                      (F.size(F.split("masked", r"\[MASK\]")) - 1).cast("bigint").alias("n_masks"),
                      F.md5(filled).alias("filled_md5"))


# Rules of the example prompts: a parameter of ``class_rules``.
RULES = {"simple": "one table", "conditional": "a filter by cases", "aggregation": "a grouped total",
         "complex": "a grouped total over a filter by cases"}
GEN_TEMPLATE = ("Database: {db_id}\nTarget class: {target}\nRules: {rules}\n"
                "Question: {question}\nReturn JSON with question, sql and evidence.")


def _target(col="question_id"):
    k = F.col(col) % 4
    return F.when(k == 0, "simple").when(k == 1, "conditional").when(k == 2, "aggregation").otherwise("complex")


def _sql_lit(s):
    return "'" + s.replace("'", "''") + "'"


@register("render_prompts", "B21 B30", sql=f"""
with {CORPUS},
t as (select *, case question_id % 4 when 0 then 'simple' when 1 then 'conditional'
                when 2 then 'aggregation' else 'complex' end as target from sql_corpus),
p as (select question_id, concat('Database: ', db_id, chr(10), 'Target class: ', target, chr(10), 'Rules: ',
  case target {" ".join(f"when '{k}' then {_sql_lit(v)}" for k, v in RULES.items())} else '' end,
  chr(10), 'Question: ', question, chr(10), 'Return JSON with question, sql and evidence.') as prompt from t)
select question_id, md5(prompt) as prompt_md5, cast(length(prompt) as bigint) as prompt_chars,
  2 as n_messages from p""")
def render_prompts(spark, sf_dir):
    from qcorpus.functions.prompts import messages
    c = fixtures.load(spark, sf_dir, "sql_corpus").withColumn("target", _target())
    prompt = render_template(GEN_TEMPLATE, db_id="db_id", target="target",
                             rules=class_rules("target", RULES), question="question")
    out = c.select("question_id", prompt.alias("prompt"))
    return out.select("question_id", F.md5("prompt").alias("prompt_md5"),
                      F.length("prompt").cast("bigint").alias("prompt_chars"),
                      F.size(messages(None, F.col("prompt"))).alias("n_messages"))


SQL_GOT = ("regexp_replace(coalesce(" + ", ".join(
    f"case when regexp_matches(output, '{p}') then regexp_extract(output, '{p}', 1) end"
    for p in ["(?s)```sqlite(.*?)```", "(?s)```sql(.*?)```", "(?s)```(.*?)```"]) + "), '^\\s+|\\s+$', '', 'g')")


@register("tag_predictions", "B25 B11", sql=f"""
with {MO}
select doc_id, concat(case when coalesce({SQL_GOT}, '') <> '' then {SQL_GOT}
                           else regexp_replace(output, '^\\s+|\\s+$', '', 'g') end,
                      chr(9), '----- bird -----', chr(9), concat('db_', cast(doc_id % 25 as varchar))) as tagged
from model_outputs""")
def tag_predictions(spark, sf_dir):
    mo = fixtures.load(spark, sf_dir, "model_outputs")
    db = F.concat(F.lit("db_"), (F.col("doc_id") % 25).cast("string"))
    return mo.select("doc_id", tag_prediction(T.extract_fenced("output", "sql"), db).alias("tagged"))


@register("corpus_events", "A8", sql=f"""
with {CORPUS}
select case when status = 'valid_quality' then 'VALIDATED' when status is null then 'PENDING'
            else 'JUDGE_FAILED' end as event,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') as timestamp, question_id, db_id,
  substr(sql, 1, 200) as sql_preview, substr(question, 1, 120) as question_preview
from sql_corpus""")
def corpus_events(spark, sf_dir):
    c = fixtures.load(spark, sf_dir, "sql_corpus")
    ev = F.when(F.col("status") == "valid_quality", "VALIDATED").when(F.col("status").isNull(), "PENDING") \
          .otherwise("JUDGE_FAILED")
    out = to_events(c.select("question_id", "db_id", "sql", "question", "created_at", "status"), ev,
                    ts_col="created_at")
    return out.select("event", "timestamp", "question_id", "db_id", "sql_preview", "question_preview")


@register("pending_items", "A11", sql=f"""
with {CORPUS}
select question_id, db_id from sql_corpus
where question_id not in (select question_id from sql_corpus where status is not null)""")
def pending_items(spark, sf_dir):
    c = fixtures.load(spark, sf_dir, "sql_corpus")
    done = c.filter(F.col("status").isNotNull()).select("question_id")
    return pending(c.select("question_id", "db_id"), done, "question_id")
