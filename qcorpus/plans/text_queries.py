"""Registered queries over model outputs, pairs, attempts and conversations
(B11-B18, B22, B26, B30, E5, E6, D3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qcorpus.functions import text as T
from qcorpus.functions.prompts import build_messages
from qcorpus.functions.status import apply_judgment
from qcorpus.operators import attempts as A
from qcorpus.plans import fixtures
from qcorpus.plans.registry import register
from qcorpus.session import table

MO = f"model_outputs as ({fixtures.MODEL_OUTPUTS_SQL})"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def strip(x):
    return STRIP.format(x)


def first_match(x, patterns):
    return "coalesce(" + ", ".join(
        f"case when regexp_matches({x}, '{p}') then regexp_extract({x}, '{p}', 1) end" for p in patterns) + ")"


F3 = "```"
EVAL_SQL = f"coalesce({strip(first_match('output', [f'(?is){F3}SR\\s*(.*?)(?:{F3}|$)', f'(?is){F3}\\s*(.*?)(?:{F3}|$)']))}, {strip('output')})"
STAGE_GOT = first_match('output', [f'(?s){F3}SR\\s*(.*?){F3}', f'(?s){F3}SR\\s*(.*?)$', f'(?s){F3}\\s*(.*?){F3}', f'(?s){F3}\\s*(.*?)$'])
STAGE_SQL = f"coalesce({strip('regexp_replace(' + strip(STAGE_GOT) + ', ' + chr(39) + '(?i)^SR' + chr(92) + 's*' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, {strip('output')})"
STRICT_SQL = f"coalesce({strip(first_match('output', [f'(?s){F3}SR(.*?){F3}']))}, '')"
SQL_GOT = strip(first_match('output', [f'(?s){F3}sqlite(.*?){F3}', f'(?s){F3}sql(.*?){F3}', f'(?s){F3}(.*?){F3}']))
SQL_SQL = f"case when coalesce({SQL_GOT}, '') <> '' then {SQL_GOT} else {strip('output')} end"


@register("extract_fenced", "B11 Q7", sql=f"""
with {MO}
select doc_id, {EVAL_SQL} as eval_text, {STAGE_SQL} as stage_text, {STRICT_SQL} as strict_text,
  {SQL_SQL} as sql_text
from model_outputs""")
def extract_fenced(spark, sf_dir):
    mo = fixtures.load(spark, sf_dir, "model_outputs")
    return mo.select("doc_id", T.extract_fenced("output", "eval").alias("eval_text"),
                     T.extract_fenced("output", "stage").alias("stage_text"),
                     T.extract_fenced("output", "strict").alias("strict_text"),
                     T.extract_fenced("output", "sql").alias("sql_text"))


@register("split_reasoning", "B12", sql=f"""
with {MO}
select doc_id,
  case when regexp_matches(output, '(?s)<think>(.*?)</think>')
       then {strip("regexp_extract(output, '(?s)<think>(.*?)</think>', 1)")} else '' end as reasoning,
  {strip("replace(case when instr(output, '</think>') > 0 then " + strip("split_part(output, '</think>', 2)") + " else output end, '<|im_end|>', '')")} as content
from model_outputs""")
def split_reasoning(spark, sf_dir):
    mo = fixtures.load(spark, sf_dir, "model_outputs")
    r = T.split_reasoning("output")
    return mo.select("doc_id", r["reasoning"].alias("reasoning"), r["content"].alias("content"))


JSON_TEXT_SQL = ("replace(regexp_replace(regexp_replace(output, '(?s)<think>.*?</think>', '', 'g'), "
                 "'(?i)```(?:json)?\\s*', '', 'g'), '```', '')")


@register("parse_json_object", "B13 B26", sql=f"""
with {MO},
j as (select doc_id, case when regexp_matches({JSON_TEXT_SQL}, '(?s)\\{{.*\\}}')
                     then regexp_extract({JSON_TEXT_SQL}, '(?s)(\\{{.*\\}})', 1) end as json_text from model_outputs),
p as (select doc_id, json_text, case when json_valid(json_text) then json_text end as ok from j)
select doc_id, json_text, json_extract_string(ok, '$.sql') as sql,
  cast(json_extract(ok, '$.is_correct') as boolean) as is_correct,
  case when ok is null then 'judge_failed'
       when json_extract(ok, '$.is_correct') is null or json_extract(ok, '$.reasoning') is null then 'judge_failed'
       when cast(json_extract(ok, '$.is_correct') as boolean) then 'valid_quality' else 'invalid_quality' end as status,
  case when ok is null then 'generation_failed'
       when json_extract(ok, '$.is_correct') is null or json_extract(ok, '$.reasoning') is null then 'invalid_output_format'
       end as judge_error
from p""")
def parse_json_object(spark, sf_dir):
    mo = fixtures.load(spark, sf_dir, "model_outputs")
    js = T.json_object_text("output")
    v = T.parse_json_object("output")
    parsed = F.when(v.isNotNull(), F.struct(F.try_variant_get(v, "$.is_correct", "boolean").alias("is_correct"),
                                            F.try_variant_get(v, "$.reasoning", "string").alias("reasoning")))
    j = apply_judgment(F.lit(True), parsed)
    return mo.select("doc_id", js.alias("json_text"), F.try_variant_get(v, "$.sql", "string").alias("sql"),
                     F.try_variant_get(v, "$.is_correct", "boolean").alias("is_correct"),
                     j["status"].alias("status"), j["judge_error"].alias("judge_error"))


def _trunc_sql(x, stops):
    for s in stops:
        lit = "'" + s.replace("'", "''") + "'"
        if "\n" in s:
            lit = "||".join(["chr(10)" if ch == "\n" else "'" + ch + "'" for ch in s])
        x = f"split_part({x}, {lit}, 1)"
    return x


@register("truncate_normalize", "B14 B15 B17", sql=f"""
with {MO}
select doc_id, {_trunc_sql('output', T.GENERATION_STOPS)} as truncated,
  {strip("regexp_replace(replace(replace(replace(lower(output), '(', ''), ')', ''), '`', ''), '\\s+', ' ', 'g')")} as normalized,
  coalesce(nullif(array_to_string(list_transform(list_filter(regexp_extract_all(output, '(\\w+)\\.(\\w+)', 2),
      lambda c: length(c) <= 3 and c = lower(c) and c <> upper(c) and
           c in ({", ".join("'" + k + "'" for k in T.ABBREVIATIONS)})),
      lambda c: concat(c, '=', case c {" ".join(f"when '{k}' then '{v}'" for k, v in T.ABBREVIATIONS.items())} end)), '; '), ''),
    '{T.EVIDENCE_FALLBACK}') as evidence
from model_outputs""")
def truncate_normalize(spark, sf_dir):
    mo = fixtures.load(spark, sf_dir, "model_outputs")
    return mo.select("doc_id", T.truncate_at("output").alias("truncated"),
                     T.normalize_text("output").alias("normalized"),
                     T.auto_evidence("output").alias("evidence"))


@register("exact_match", "B15 B16", sql=f"""
with sql_pairs as ({fixtures.SQL_PAIRS_SQL})
select pair_id,
  case when {strip("regexp_replace(replace(replace(replace(lower(pred), '(', ''), ')', ''), '`', ''), '\\s+', ' ', 'g')")}
          = {strip("regexp_replace(replace(replace(replace(lower(gold), '(', ''), ')', ''), '`', ''), '\\s+', ' ', 'g')")}
       then cast(1.0 as double) else cast(0.0 as double) end as em
from sql_pairs""")
def exact_match(spark, sf_dir):
    p = fixtures.load(spark, sf_dir, "sql_pairs")
    return p.select("pair_id", T.exact_match("pred", "gold").alias("em"))


# --- attempts ---------------------------------------------------------------

ATT = f"attempts as ({fixtures.ATTEMPTS_SQL})"
ACC = """acc as (select item_id, max(target) as target,
  min(case when cls = target then attempt end) as accepted_attempt from attempts group by item_id)"""
OUTCOME = """case when cls = 'parse_error' then 'parse_error' when cls is null then 'no_bucket_active'
  when cls = a.target then 'accepted' when a.target = 'aggregation' and cls = 'complex' then 'forbidden_kw'
  else 'wrong_class' end"""


@register("resolve_attempts", "E5", sql=f"""
with {ATT}, {ACC}
select item_id, target,
  case when accepted_attempt is not null then 'accepted' else 'max_retry_exhausted' end as resolution,
  cast(accepted_attempt as bigint) as accepted_attempt,
  case when accepted_attempt is not null then accepted_attempt > 1 end as was_refined
from acc""")
def resolve_attempts(spark, sf_dir):
    return A.resolve_attempts(fixtures.load(spark, sf_dir, "attempts"))


@register("attempt_outcomes", "E6", sql=f"""
with {ATT}, {ACC}
select a.item_id, a.attempt, a.target, a.cls, {OUTCOME} as outcome, a.attempt > 1 as refined
from attempts a join acc on a.item_id = acc.item_id
where acc.accepted_attempt is null or a.attempt <= acc.accepted_attempt""")
def attempt_outcomes(spark, sf_dir):
    return A.attempt_outcomes(fixtures.load(spark, sf_dir, "attempts")).drop("ts")


@register("attempt_stats", "D3", sql=f"""
with {ATT}, {ACC},
o as (select {OUTCOME} as outcome, a.attempt > 1 as refined
      from attempts a join acc on a.item_id = acc.item_id
      where acc.accepted_attempt is null or a.attempt <= acc.accepted_attempt)
select count(*) as attempts, count(*) filter (where outcome = 'accepted') as accepted,
  count(*) filter (where refined) as refined, count(*) filter (where outcome = 'parse_error') as parse_err,
  count(*) filter (where outcome = 'no_bucket_active') as no_bucket_active,
  count(*) filter (where outcome = 'wrong_class') as wrong_class,
  count(*) filter (where outcome = 'forbidden_kw') as forbidden_kw, cast(0 as bigint) as timeout
from o""")
def attempt_stats(spark, sf_dir):
    return A.attempt_stats(A.attempt_outcomes(fixtures.load(spark, sf_dir, "attempts")))


# --- conversations ------------------------------------------------------------

@register("chat_messages", "B30", sql="""
with c as (select conv_id,
  bool_or(role = 'system') as has_system,
  string_agg(role, ',' order by turn) as roles,
  count(*) as n_turns, sum(length(text)) as chars
  from conversations group by conv_id)
select conv_id,
  case when has_system then roles else concat('system,', roles) end as roles,
  cast(n_turns + case when has_system then 0 else 1 end as bigint) as n_messages,
  cast(chars + case when has_system then 0 else length('You are a helpful assistant.') end as bigint) as chars
from c""")
def chat_messages(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    msgs = build_messages(conv, "conv_id", "turn", "role", "text")
    return msgs.select(
        "conv_id",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.size("messages").cast("bigint").alias("n_messages"),
        F.aggregate("messages", F.lit(0).cast("bigint"),
                    lambda acc, m: acc + F.length(m["content"])).alias("chars"),
    )


@register("result_preview", "B22", sql="""
with r as (select conv_id, turn, concat(role, ': ', cast(length(text) as varchar)) as rendered,
                  row_number() over (partition by conv_id order by turn) as rn from conversations),
g as (select conv_id, count(*) as n,
  string_agg(case when rn <= 10 then concat('  ', rendered, ',', chr(10)) end, '' order by turn) as body
  from r group by conv_id)
select conv_id, case when n = 0 then '[]  # Empty result'
  else concat('[', chr(10), body, case when n > 10 then concat('  ... (', cast(n - 10 as varchar), ' more rows)', chr(10)) else '' end, ']') end as preview
from g""")
def result_preview(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    rows = conv.select("conv_id", "turn", F.concat("role", F.lit(": "), F.length("text").cast("string")).alias("r"))
    # first 10 rows per group (window-group-limit keeps only 10 per group
    # before the shuffle) and the group size, both bounded per conversation
    w = Window.partitionBy("conv_id").orderBy("turn")
    head = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 10) \
               .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "r"))).alias("head"))
    n = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(head, "conv_id", "left")
    preview = T.result_preview(F.transform("head", lambda x: x["r"]), n=F.col("n"))
    return j.select("conv_id", preview.alias("preview"))
