"""Registered queries: vectors, evaluation, trials, event streams and the SQL
families (B28, C8-C10, C12, D9-D12, D16, D17, D19, D20, E8, E9, F1, F2, G2,
H2, H3, I2, I7, B29, J1-J4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qcorpus.operators import evaluate as EV
from qcorpus.operators import trials as TR
from qcorpus.operators import vectors as V
from qcorpus.operators.vector_index import build_index, search_index
from qcorpus.plans import fixtures
from qcorpus.plans.registry import register
from qcorpus.session import checkpoint_dir, table
from qcorpus.streaming import events as ST

# every stored vector whose id is divisible by 20 asks for its neighbours
SIMS_SQL = """v as (select vec_id as id, cast(embedding as double[]) as e from embeddings),
sims as (select q.id as query_id, v.id, list_cosine_similarity(q.e, v.e) as similarity
         from v q, v where q.id % 20 = 0 and q.id <> v.id),
ranked as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims)"""


def _stored_queries(vec):
    return vec.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def _topk(spark, sf_dir, k):
    vec = fixtures.load(spark, sf_dir, "vectors")
    return V.top_k_similar(_stored_queries(vec), vec, k=k, exclude_self=True)


@register("top_k_similar", "C8 E8 B28", sql=f"""
with {SIMS_SQL}
select query_id, id, cast(rank as bigint) as rank, round(similarity, 6) as similarity from ranked where rank <= 3""")
def top_k_similar(spark, sf_dir):
    r = _topk(spark, sf_dir, 3)
    return r.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"),
                    F.round("similarity", 6).alias("similarity"))


def vector_metadata(vectors):
    """Stored-vector metadata: two vectors per source example; every
    seventh has an empty SQL (dropped by retrieval)."""
    vid = F.col("id")
    return vectors.select("id", F.floor(vid / 2).cast("bigint").alias("source_id"),
                          F.concat(F.lit("question "), F.floor(vid / 2).cast("string")).alias("question"),
                          F.when(vid % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("SELECT "), vid.cast("string")))
                          .alias("sql"))


@register("retrieve_examples", "C10 E8", sql=f"""
with {SIMS_SQL},
hits as (select query_id, id, rank, id // 2 as source_id, concat('question ', cast(id // 2 as varchar)) as question,
                case when id % 7 = 0 then '' else concat('SELECT ', cast(id as varchar)) end as sql
         from ranked where rank <= 5),
firsts as (select *, row_number() over (partition by query_id, source_id order by rank) as f from hits),
kept as (select * from firsts where f = 1 and question <> '' and sql <> ''),
g as (select query_id, string_agg(concat('-- Example Question: ', question, chr(10), '-- Example SQL: ', sql),
                                  chr(10) || chr(10) order by rank) as examples, count(*) as n from kept group by 1)
select q.query_id, coalesce(examples, '(No similar examples found)') as examples, coalesce(n, 0) as n_examples
from (select vec_id as query_id from embeddings where vec_id % 20 = 0) q left join g on q.query_id = g.query_id""")
def retrieve_examples(spark, sf_dir):
    vec = fixtures.load(spark, sf_dir, "vectors")
    hits = _topk(spark, sf_dir, 5)
    return V.retrieve_examples(hits, vector_metadata(vec), _stored_queries(vec))


PROBES = 0.7  # the given vectors lie all around the sphere: neighbours are spread over many cells


def _cells_sql(iterations=2):
    """The index in SQL: seeds by MD5 of the id, k-means rounds, nearest cell."""
    near = ("select id, e, c as cell from (select u.id, u.e, k.c, row_number() over (partition by u.id order by "
            "list_inner_product(u.e, k.m) desc, k.c) as r from u, {0} k) where r = 1")
    out = """u as (select id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v),
n as (select cast(round(sqrt(count(*))) as int) as cells from u),
k0 as (select c, m from (select row_number() over (order by md5(cast(id as varchar)), id) - 1 as c, e as m from u), n where c < cells),
"""
    for i in range(iterations):
        out += f"""a{i} as ({near.format(f"k{i}")}),
s{i} as (select c, list(m order by pos) as m from (
  select cell as c, pos, avg(x) as m from (select cell, unnest(e) as x, generate_subscripts(e, 1) as pos from a{i}) group by 1, 2) group by 1),
k{i + 1} as (select k.c, case when s.c is null then k.m else list_transform(s.m, lambda x: x / sqrt(list_inner_product(s.m, s.m))) end as m
  from k{i} k left join s{i} s on k.c = s.c),
"""
    return out + f"a as ({near.format(f'k{iterations}')}),\nk as (select * from k{iterations})"


@register("approx_similar", "C9", sql=f"""
with v as (select vec_id as id, cast(embedding as double[]) as e from embeddings),
{_cells_sql()},
probed as (select id, c from (
  select u.id, k.c, row_number() over (partition by u.id order by list_inner_product(u.e, k.m) desc, k.c) as r
  from u, k where u.id % 20 = 0), n where r <= round({PROBES} * cells)),
sims as (select q.id as query_id, x.id, list_inner_product(q.e, x.e) as similarity
         from probed p join u q on q.id = p.id join a x on x.cell = p.c where x.id <> q.id),
ranked as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims)
select query_id, id, cast(rank as bigint) as rank, round(similarity, 6) as similarity from ranked where rank <= 3""")
def approx_similar(spark, sf_dir):
    vec = fixtures.load(spark, sf_dir, "vectors")
    index = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    build_index(vec, index)
    r = search_index(index, _stored_queries(vec), k=3, probes=PROBES, exclude_self=True)
    return r.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"),
                    F.round("similarity", 6).alias("similarity"))


@register("batch_ids", "E9", sql="""
select vec_id as id, cast((row_number() over (order by vec_id) - 1) // 64 as bigint) as batch_id from embeddings""")
def batch_ids(spark, sf_dir):
    vec = fixtures.load(spark, sf_dir, "vectors").select("id")
    return V.batch_ids(vec, "id", 64)


@register("embed_documents", "I2 B28")
def embed_documents(spark, sf_dir):
    from qcorpus.session import spread
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    e = V.batch_embed(docs, "text")
    return e.select("doc_id", F.size("embedding").cast("bigint").alias("dim"),
                    F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"),
                                               lambda a, x: a + x * x)), 6).alias("norm"))


GREEDY_SQL = """
with t as (select vec_id // 8 as pair_id, vec_id % 2 as side, vec_id as pos, cast(embedding as double[]) as u from embeddings),
s as (select p.pair_id, p.pos as pp, g.pos as gp, list_cosine_similarity(p.u, g.u) as sim
      from t p join t g on p.pair_id = g.pair_id and p.side = 0 and g.side = 1),
pr as (select pair_id, avg(m) as p from (select pair_id, pp, max(sim) as m from s group by 1, 2) group by 1),
rc as (select pair_id, avg(m) as r from (select pair_id, gp, max(sim) as m from s group by 1, 2) group by 1)
select pair_id, round(p, 6) as bert_precision, round(r, 6) as bert_recall,
  round(case when p + r <> 0 then 2 * p * r / (p + r) else 0 end, 6) as bert_f1
from pr join rc using (pair_id)
union all
select pair_id, 0.0, 0.0, 0.0 from t group by pair_id having count(distinct side) < 2"""


def pair_tokens(spark, sf_dir):
    """Token vectors of pairs: eight embeddings each, on two sides."""
    return table(spark, sf_dir, "embeddings").select(
        (F.floor(F.col("vec_id") / 8)).cast("bigint").alias("pair_id"),
        (F.col("vec_id") % 2).alias("side"), F.col("vec_id").alias("pos"), "embedding")


@register("greedy_match", "C12", sql=GREEDY_SQL)
def greedy_match(spark, sf_dir):
    g = EV.greedy_match_score(pair_tokens(spark, sf_dir))
    return g.select("pair_id", *[F.round(c, 6).alias(c) for c in ("bert_precision", "bert_recall", "bert_f1")])


def _tokens_sql(text):
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> '')"


# the rows of the table of common subsequences, folded over the prediction's tokens
# (the words of the given pairs are their own stems)
ROUGE_SQL = f"""toks as (select pair_id, {_tokens_sql("pred")} as a, {_tokens_sql("gold")} as b from sql_pairs),
lcs as (select pair_id, len(a) as n, len(b) as m, coalesce(list_reduce(
    list_prepend(list_transform(b, lambda y: cast(0 as bigint)),
                 list_transform(a, lambda x: list_transform(b, lambda y: cast(x = y as bigint)))),
    lambda top, eq: list_transform(range(1, len(top) + 1), lambda j: list_max(list_transform(
        range(1, j + 1), lambda i: greatest(top[i], coalesce(top[i - 1], 0) + eq[i])))))[-1], 0) as l from toks),
pr as (select pair_id, case when n > 0 then l / n else 0.0 end as p, case when m > 0 then l / m else 0.0 end as r from lcs),
rouge as (select pair_id, p as rougeL_p, r as rougeL_r, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as rougeL_f1 from pr)"""


@register("rouge_l", "I7 I8", sql=f"""
with sql_pairs as ({fixtures.SQL_PAIRS_SQL}),
{ROUGE_SQL}
select * from rouge""")
def rouge_l(spark, sf_dir):
    p = fixtures.load(spark, sf_dir, "sql_pairs")
    r = EV.rouge_l("pred", "gold")
    return p.select("pair_id", r.alias("r")).select("pair_id", F.col("r.p").alias("rougeL_p"),
                                                     F.col("r.r").alias("rougeL_r"), F.col("r.f1").alias("rougeL_f1"))


@register("latency_summary", "D9", sql="""
select event_type, count(value) as n, round(coalesce(sum(value), 0.0), 4) as total_latency,
  round(coalesce(sum(value), 0.0) / greatest(count(value), 1), 4) as avg_latency,
  round(coalesce(min(value), 0.0), 4) as min_latency, round(coalesce(max(value), 0.0), 4) as max_latency
from events group by 1""")
def latency_summary(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return EV.latency_summary(ev, "value", ["event_type"])


MODULE = "case pair_id % 3 when 0 then 'bam' when 1 then 'sam' else 'lom' end"
EM = """case when regexp_replace(regexp_replace(replace(replace(replace(lower(pred), '(', ''), ')', ''), '`', ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')
           = regexp_replace(regexp_replace(replace(replace(replace(lower(gold), '(', ''), ')', ''), '`', ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')
         then 1.0 else 0.0 end"""


def _pair_metrics(spark, sf_dir):
    from qcorpus.functions.text import exact_match
    p = fixtures.load(spark, sf_dir, "sql_pairs")
    k = F.col("pair_id") % 3
    return p.select("pair_id", F.when(k == 0, "bam").when(k == 1, "sam").otherwise("lom").alias("module"),
                    F.when(F.col("pair_id") % 2 == 0, "tuned").otherwise("baseline").alias("variant"),
                    exact_match("pred", "gold").alias("em"), "latency")


@register("metric_summary", "D10", sql=f"""
with sql_pairs as ({fixtures.SQL_PAIRS_SQL})
select {MODULE} as module, count(*) as n, round(avg({EM}), 4) as mean_em, round(avg(latency), 4) as mean_latency
from sql_pairs group by 1""")
def metric_summary(spark, sf_dir):
    return EV.metric_summary(_pair_metrics(spark, sf_dir), ["module"], ["em", "latency"])


@register("compare_variants", "D11", sql=f"""
with sql_pairs as ({fixtures.SQL_PAIRS_SQL})
select {MODULE} as module, case when pair_id % 2 = 0 then 'tuned' else 'baseline' end as variant, count(*) as n,
  round(avg({EM}), 4) as mean_em, round(avg(latency), 4) as mean_latency
from sql_pairs group by 1, 2""")
def compare_variants(spark, sf_dir):
    return EV.metric_summary(_pair_metrics(spark, sf_dir), ["module", "variant"], ["em", "latency"])


@register("token_usage", "D12", sql="""
with calls as (select conv_id,
  sum(case when role <> 'assistant' then len(regexp_extract_all(text, '\\S+')) else 0 end) as prompt_tokens,
  sum(case when role = 'assistant' then len(regexp_extract_all(text, '\\S+')) else 0 end) as completion_tokens
  from conversations group by 1)
select count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens,
  cast(sum(completion_tokens) as bigint) as completion_tokens,
  cast(sum(prompt_tokens + completion_tokens) as bigint) as total_tokens,
  round(avg(prompt_tokens + completion_tokens), 4) as avg_total_tokens from calls""")
def token_usage(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    n = F.regexp_count("text", F.lit(r"\S+")).cast("bigint")
    calls = conv.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("completion_tokens"))
    return EV.token_usage_summary(calls)


RESULT_SETS = """gold as (select o_custkey as pair_id, o_orderkey as r from orders where o_orderstatus = 'F'),
pred as (select o_custkey as pair_id, o_orderkey as r from orders where o_orderstatus = 'F' and o_totalprice > 50000),
diff as (select distinct pair_id from ((select * from gold except all select * from pred)
                                       union all (select * from pred except all select * from gold))),
m as (select p.pair_id, d.pair_id is null as match from (select distinct o_custkey as pair_id from orders) p
      left join diff d on p.pair_id = d.pair_id)"""


def _result_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    gold = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("r"))
    pred = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 50000)) \
            .select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("r"))
    return EV.same_result(gold, pred, o.select(F.col("o_custkey").alias("pair_id")))


@register("same_result", "G2", sql=f"with {RESULT_SETS} select pair_id, match from m")
def same_result(spark, sf_dir):
    return _result_sets(spark, sf_dir)


@register("execution_accuracy", "D19 G2", sql=f"""
with {RESULT_SETS} select count(*) as n, round(avg(cast(match as double)), 6) as execution_accuracy from m""")
def execution_accuracy(spark, sf_dir):
    return EV.execution_accuracy(_result_sets(spark, sf_dir))


@register("throughput", "D20", sql="""
with g as (select event_type, count(*) as items, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as el from events group by 1)
select event_type, items, round(el, 6) as elapsed_sec,
  round(case when el > 0 then items / el else 0.0 end, 6) as rate,
  case when round(case when el > 0 then items / el else 0.0 end, 6) > 0
       then round((5000 - items) / round(case when el > 0 then items / el else 0.0 end, 6), 6) else 0.0 end as eta_sec
from g""")
def throughput(spark, sf_dir):
    return EV.throughput(table(spark, sf_dir, "events"), "ts", target=5000, group_cols=["event_type"])


# --- trials -----------------------------------------------------------------

def _trial_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("trial"), F.col("event_id").alias("step"),
                     F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"))


def _trial_params(spark, sf_dir):
    trials = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial")).distinct()
    rank = F.element_at(F.array(*[F.lit(x) for x in TR.LORA_RANKS]), (F.col("trial") % 4 + 1).cast("int")).cast("bigint")
    bs = F.element_at(F.array(*[F.lit(x) for x in TR.BATCH_SIZES]), (F.col("trial") % 3 + 1).cast("int")).cast("bigint")
    out = trials.select("trial", rank.alias("lora_rank"), bs.alias("batch_size"),
                        F.round(F.lit(1e-5) * (F.lit(1) + F.col("trial") % 10), 8).alias("learning_rate"))
    return out.withColumns(TR.derived_trial_columns(F.col("lora_rank"), F.col("batch_size")))


TRIAL_SQL = """log as (select user_id as trial, event_id as step, case when event_type = 'view' then value end as eval_loss from events),
losses as (select trial, count(eval_loss) as n_evals, min(eval_loss) as best_loss,
                  arg_max(eval_loss, case when eval_loss is not null then step end) as last_loss,
                  count(eval_loss) = 0 as failed from log group by 1),
params as (select trial, cast([8, 16, 32, 64][trial % 4 + 1] as bigint) as lora_rank,
                  cast([2, 4, 8][trial % 3 + 1] as bigint) as batch_size,
                  round(1e-5 * (1 + trial % 10), 8) as learning_rate from (select distinct user_id as trial from events)),
full_params as (select *, lora_rank * 2 as lora_alpha, cast(floor(16 / batch_size) as bigint) as gradient_accumulation,
                  batch_size * cast(floor(16 / batch_size) as bigint) as effective_batch from params)"""


@register("trial_table", "B29", sql=f"with {TRIAL_SQL} select * from full_params")
def trial_table(spark, sf_dir):
    return _trial_params(spark, sf_dir)


@register("trial_losses", "D16", sql=f"with {TRIAL_SQL} select * from losses")
def trial_losses(spark, sf_dir):
    return TR.trial_losses(_trial_log(spark, sf_dir))


@register("trial_states", "D17", sql=f"""
with {TRIAL_SQL},
s as (select case when failed then 'FAIL' when last_loss > best_loss * 1.5 then 'PRUNED' else 'COMPLETE' end as st from losses)
select count(*) filter (where st <> 'FAIL') as finished, count(*) filter (where st = 'PRUNED') as pruned,
  count(*) filter (where st = 'COMPLETE') as complete, count(*) filter (where st = 'FAIL') as failed from s""")
def trial_states(spark, sf_dir):
    return TR.trial_states(TR.trial_losses(_trial_log(spark, sf_dir)))


@register("top_trials", "F1", sql=f"""
with {TRIAL_SQL}
select l.trial, l.best_loss, p.lora_rank, p.learning_rate, p.batch_size from losses l join full_params p using (trial)
where best_loss is not null order by best_loss, trial limit 10""")
def top_trials(spark, sf_dir):
    j = TR.trial_losses(_trial_log(spark, sf_dir)).join(_trial_params(spark, sf_dir), "trial")
    return TR.top_trials(j.select("trial", "best_loss", "lora_rank", "learning_rate", "batch_size"))


@register("best_trial", "F2", sql=f"""
with {TRIAL_SQL}
select l.trial, l.best_loss, p.lora_rank, p.lora_alpha, p.learning_rate, p.batch_size, p.gradient_accumulation,
  p.effective_batch from losses l join full_params p using (trial) where best_loss is not null
order by best_loss, trial limit 1""")
def best_trial(spark, sf_dir):
    j = TR.trial_losses(_trial_log(spark, sf_dir)).join(_trial_params(spark, sf_dir), "trial")
    return TR.best_trial(j.select("trial", "best_loss", "lora_rank", "lora_alpha", "learning_rate", "batch_size",
                                  "gradient_accumulation", "effective_batch"))


# --- event streams (batch run of the streaming functions) --------------------

@register("stream_progress", "H1 H2", sql="""
select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as event,
  count(*) as count from events group by 1, 2""")
def stream_progress(spark, sf_dir):
    ev = ST.as_event_log(table(spark, sf_dir, "events"))
    out = ST.stream_progress(ev, "1 hour", watermark=None)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event", "count")


@register("assemble_tokens", "H3", sql="""
with t as (select event_id // 8 as request_id, event_id as seq, case when event_id % 8 = 0 then '' else ' ' end || event_type as token,
                  event_id % 8 = 7 as done, event_type = 'error' as err from events),
c as (select request_id, min(case when done or err then seq end) as close_seq from t group by 1)
select t.request_id, string_agg(token, '' order by seq) as message, count(*) as n_tokens,
  coalesce(bool_or(seq = close_seq and done), false) as done,
  coalesce(bool_or(seq = close_seq and err and not done), false) as has_error
from t join c on t.request_id = c.request_id where close_seq is null or seq <= close_seq group by 1""")
def assemble_tokens(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    toks = ev.select(F.floor(F.col("event_id") / 8).cast("bigint").alias("request_id"), F.col("event_id").alias("seq"),
                     F.concat(F.when(F.col("event_id") % 8 == 0, "").otherwise(" "), "event_type").alias("token"), (F.col("event_id") % 8 == 7).alias("done"),
                     F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))
    return ST.assemble_tokens(toks).select("request_id", "message", "n_tokens", "done", "has_error")


# --- SQL families -----------------------------------------------------------

FAMILIES = {
    "simple": ("SELECT DISTINCT c.c_name, n.n_name FROM {customer} c JOIN {nation} n "
               "ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 5000"),
    "conditional": ("SELECT o.o_orderkey, CASE WHEN o.o_totalprice > 200000 THEN 'high' ELSE 'low' END AS price_band "
                    "FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey "
                    "WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND c.c_mktsegment LIKE 'BUILD%'"),
    "aggregation": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, "
                    "ROUND(AVG(l_extendedprice), 4) AS avg_price, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax "
                    "FROM {lineitem} WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus"),
    "complex": ("SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, "
                "COUNT(DISTINCT o.o_orderkey) AS n_orders FROM {lineitem} l "
                "JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey "
                "JOIN {nation} n ON c.c_nationkey = n.n_nationkey "
                "WHERE o.o_orderstatus IN ('F', 'O') AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 90 DAY "
                "GROUP BY n.n_name HAVING SUM(l.l_extendedprice) > (SELECT AVG(o2.o_totalprice) FROM {orders} o2)"),
}


def family_sql(name: str) -> str:
    """A family statement with plain table names (as stored in a corpus)."""
    return FAMILIES[name].replace("{", "").replace("}", "")


def _family(name):
    def run(spark, sf_dir):
        tabs = {t: table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "lineitem")}
        used = {k: v for k, v in tabs.items() if "{" + k + "}" in FAMILIES[name]}
        return spark.sql(FAMILIES[name], **used)
    return run


for _i, _name in enumerate(FAMILIES, 1):
    register(f"family_{_name}", f"J{_i}", sql=family_sql(_name))(_family(_name))
