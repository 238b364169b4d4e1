"""Registered queries over the derived catalog: flattening, schema graph,
schema text, key maps, linking, walks and prompt budgets (A4, C1-C7, C11,
D13-D15, E3, E4, G1, G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qcorpus.operators import catalog as K
from qcorpus.operators import linking as L
from qcorpus.operators import walks as W
from qcorpus.plans import fixtures
from qcorpus.plans.registry import register
from qcorpus.session import table
from qcorpus.sources.catalog import flatten_catalog

CAT = fixtures.catalog_sql_ctes()
NAMED = """named as (select c.db_id, c.col_idx, c.table_idx, t.table_name, c.column_name
  from cat_columns c join cat_tables t on c.db_id = t.db_id and c.table_idx = t.table_idx)"""
FK = f"""{NAMED},
fk as (select f.db_id, f.fk_pos, s.table_name as src_table, s.column_name as src_column,
              t.table_name as tgt_table, t.column_name as tgt_column
  from cat_fks f join named s on f.db_id = s.db_id and f.src_col_idx = s.col_idx
                 join named t on f.db_id = t.db_id and f.tgt_col_idx = t.col_idx),
edges as (select db_id, src_table as src, tgt_table as tgt from fk
          union select db_id, tgt_table as src, src_table as tgt from fk)"""


def catalog(spark, sf_dir):
    """The derived catalog, materialised once in the checkpoint folder: it is
    tiny (one row per database) but its derivation scans ``orders``, and the
    schema graph, walks and linking refer to it many times per plan."""
    from qcorpus.session import cut_lineage
    return flatten_catalog(cut_lineage(fixtures.load(spark, sf_dir, "catalog")))


@register("catalog_columns", "A4", sql=f"""
with {CAT}, {NAMED}
select db_id, cast(col_idx as bigint) as col_idx, cast(table_idx as bigint) as table_idx, table_name, column_name
from named""")
def catalog_columns(spark, sf_dir):
    return K.named_columns(catalog(spark, sf_dir)).select(
        "db_id", F.col("col_idx").cast("bigint").alias("col_idx"),
        F.col("table_idx").cast("bigint").alias("table_idx"), "table_name", "column_name")


@register("resolve_foreign_keys", "C1", sql=f"""
with {CAT}, {FK}
select db_id, cast(fk_pos as bigint) as fk_pos, src_table, src_column, tgt_table, tgt_column from fk""")
def resolve_foreign_keys(spark, sf_dir):
    return K.resolve_foreign_keys(catalog(spark, sf_dir)).withColumn("fk_pos", F.col("fk_pos").cast("bigint"))


@register("fk_edges", "G1", sql=f"""
with {CAT}, {FK}
select db_id, src, tgt from edges""")
def fk_edges(spark, sf_dir):
    return K.fk_edges(catalog(spark, sf_dir))


SCHEMA_EDGES = f"""
graph_edges as (select db_id, concat(db_id, '.', table_name) as src, concat(db_id, '.', table_name, '.', column_name) as dst,
                       'type_2_containment' as relation from named
                union select db_id, concat(db_id, '.', src), concat(db_id, '.', tgt), 'type_3_fk' from edges),
graph_nodes as (select concat(db_id, '.', table_name) as node from cat_tables
                union select concat(db_id, '.', table_name, '.', column_name) from named)"""


@register("schema_graph", "G4", sql=f"""
with {CAT}, {FK}, {SCHEMA_EDGES}
select db_id, src, dst, relation from graph_edges""")
def schema_graph(spark, sf_dir):
    _, edges = K.schema_graph(catalog(spark, sf_dir))
    return edges


@register("graph_counts", "D15", sql=f"""
with {CAT}, {FK}, {SCHEMA_EDGES}
select (select count(*) from graph_nodes) as nodes,
       (select count(*) from (select distinct src, dst from graph_edges)) as edges""")
def graph_counts(spark, sf_dir):
    return K.graph_counts(catalog(spark, sf_dir))


QI = "case when instr({0}, ' ') > 0 then concat('`', {0}, '`') else {0} end"
SCHEMA_TEXT = f"""
per_table as (select db_id, table_idx,
  string_agg(concat({QI.format('table_name')}, '.', {QI.format('column_name')}), ''', ''' order by col_idx) as cs
  from named group by 1, 2),
blocks as (select t.db_id, t.table_idx, concat('### Table: ', t.table_name, chr(10),
  case when cs is null then '[]' else concat('[''', cs, ''']') end) as b
  from cat_tables t left join per_table p on t.db_id = p.db_id and t.table_idx = p.table_idx),
schemas as (select db_id, string_agg(b, chr(10) || chr(10) order by table_idx) as schema_text from blocks group by 1)"""


@register("schema_text", "D13 B18", sql=f"""
with {CAT}, {NAMED}, {SCHEMA_TEXT}
select db_id, schema_text from schemas""")
def schema_text(spark, sf_dir):
    return K.schema_text(catalog(spark, sf_dir))


@register("attach_schema", "C3", sql=f"""
with {CAT}, {NAMED}, {SCHEMA_TEXT}, sql_corpus as ({fixtures.SQL_CORPUS_SQL})
select question_id, s.db_id, schemas.db_id is not null as has_schema,
  cast(length(coalesce(schema_text, '')) as bigint) as schema_chars, md5(coalesce(schema_text, '')) as schema_md5
from sql_corpus s left join schemas on s.db_id = schemas.db_id""")
def attach_schema(spark, sf_dir):
    items = fixtures.load(spark, sf_dir, "sql_corpus").select("question_id", "db_id")
    j = K.attach_schema(items, K.schema_text(catalog(spark, sf_dir)))
    return j.select("question_id", "db_id", "has_schema", F.length("schema_text").cast("bigint").alias("schema_chars"),
                    F.md5("schema_text").alias("schema_md5"))


@register("key_maps_pk", "D14", sql=f"""
with {CAT}, {NAMED},
pk as (select p.db_id, p.pk_pos, p.key_pos, n.table_name, n.column_name from cat_pks p
       join named n on p.db_id = n.db_id and p.col_idx = n.col_idx),
ent as (select p.db_id, p.pk_pos, f.table_name as pk_table, string_agg(p.column_name, ',' order by p.key_pos) as pk_columns
        from pk p join (select db_id, pk_pos, table_name from pk where key_pos = 0) f
        on p.db_id = f.db_id and p.pk_pos = f.pk_pos group by 1, 2, 3)
select db_id, pk_table as "table", arg_max(pk_columns, pk_pos) as pk_columns from ent group by 1, 2""")
def key_maps_pk(spark, sf_dir):
    pk, _ = K.key_maps(catalog(spark, sf_dir))
    return pk


@register("key_maps_fk", "D14", sql=f"""
with {CAT}, {FK}
select db_id, concat(src_table, '.', src_column) as src, arg_max(concat(tgt_table, '.', tgt_column), fk_pos) as tgt
from fk group by 1, 2""")
def key_maps_fk(spark, sf_dir):
    _, fk = K.key_maps(catalog(spark, sf_dir))
    return fk


DESC_SQL = """descs as (select distinct table_name as "table", column_name as "column",
  case when instr(column_name, '_') > 0 then concat('the ', regexp_extract(column_name, '^[^_]*_(.*)$', 1)) else '' end
  as description from named)"""


def derived_descriptions(cat):
    """Column descriptions derived from the catalog itself: ``the <name
    without its table prefix>`` for prefixed names, empty otherwise."""
    n = K.named_columns(cat)
    return n.select(F.col("table_name").alias("table"), F.col("column_name").alias("column"),
                    F.when(F.instr("column_name", "_") > 0,
                           F.concat(F.lit("the "), F.regexp_extract("column_name", r"^[^_]*_(.*)$", 1)))
                    .otherwise(F.lit("")).alias("description")).distinct()


@register("describe_columns", "C2", sql=f"""
with {CAT}, {NAMED}, {DESC_SQL}
select n.db_id, n.table_name, n.column_name, coalesce(d.description, '') as description
from named n left join (select lower(concat("table", '.', "column")) as key, max(description) as description
                        from descs group by 1) d
  on lower(concat(n.table_name, '.', n.column_name)) = d.key""")
def describe_columns(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    return K.describe_columns(cat, derived_descriptions(cat)).select("db_id", "table_name", "column_name", "description")


# --- linking ----------------------------------------------------------------

LINK = f"""sql_corpus as ({fixtures.SQL_CORPUS_SQL}),
links as (select distinct s.question_id, n.table_name as "table", n.column_name as "column", s.db_id
  from sql_corpus s join named n on s.db_id = n.db_id
  where instr(s.sql, n.table_name) > 0 and instr(s.sql, n.column_name) > 0)"""


def _links(spark, sf_dir, text_col="sql", star=False):
    cat = catalog(spark, sf_dir)
    corpus = fixtures.load(spark, sf_dir, "sql_corpus")
    return L.link_schema(corpus, K.named_columns(cat), text_col=text_col, star=star)


@register("link_schema", "C4 Q14", sql=f"""
with {CAT}, {NAMED}, {LINK}
select question_id, "table", "column" from links""")
def link_schema(spark, sf_dir):
    return _links(spark, sf_dir)


@register("link_schema_star", "C5", sql=f"""
with {CAT}, {NAMED}, {LINK}
select question_id, "table", "column" from links
union all
select distinct s.question_id, t.table_name as "table", '*' as "column"
from sql_corpus s join cat_tables t on s.db_id = t.db_id
where instr(s.sql, '*') > 0 and instr(s.sql, t.table_name) > 0""")
def link_schema_star(spark, sf_dir):
    return _links(spark, sf_dir, star=True)


@register("covers_schema", "C6", sql=f"""
with {CAT}, {NAMED}, {LINK},
cand as (select question_id, db_id, replace(sql, 'o_totalprice', 'o_total') as sql from sql_corpus),
plinks as (select distinct s.question_id, n.table_name as "table", n.column_name as "column"
  from cand s join named n on s.db_id = n.db_id
  where instr(s.sql, n.table_name) > 0 and instr(s.sql, n.column_name) > 0),
miss as (select question_id, count(*) as m from
  (select question_id, "table", "column" from links except select question_id, "table", "column" from plinks) group by 1)
select s.question_id, miss.m is null as covers from sql_corpus s left join miss on s.question_id = miss.question_id""")
def covers_schema(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    corpus = fixtures.load(spark, sf_dir, "sql_corpus")
    cols = K.named_columns(cat)
    cand = corpus.withColumn("candidate", F.replace("sql", F.lit("o_totalprice"), F.lit("o_total")))
    return L.covers_schema(cand, cols, "sql", "candidate")


MEANINGS_SQL = """meanings as (select db_id, table_name as "table", column_name as "column",
  case col_idx % 3 when 0 then concat('#', column_name, ' of ', table_name) when 1 then concat(column_name, ' value')
       else '' end as meaning from named)"""


@register("column_meanings", "C7", sql=f"""
with {CAT}, {NAMED}, {LINK}, {MEANINGS_SQL}
select l.question_id, string_agg(concat('# ', {QI.format('l."table"')}, '.', {QI.format('l."column"')}, ': ',
  regexp_replace(m.meaning, '^#', ''), chr(10)), '' order by n.col_idx) as meaning_block
from links l join meanings m on l.db_id = m.db_id and l."table" = m."table" and l."column" = m."column"
join named n on l.db_id = n.db_id and l."table" = n.table_name and l."column" = n.column_name
where regexp_replace(m.meaning, '^#', '') <> ''
group by l.question_id""")
def column_meanings(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    corpus = fixtures.load(spark, sf_dir, "sql_corpus")
    named = K.named_columns(cat)
    links = L.link_schema(corpus.select("question_id", "db_id", "sql"), named, carry=("db_id",))
    m = F.col("col_idx") % 3
    meanings = named.select("db_id", F.col("table_name").alias("table"), F.col("column_name").alias("column"),
                            F.when(m == 0, F.concat(F.lit("#"), "column_name", F.lit(" of "), "table_name"))
                            .when(m == 1, F.concat("column_name", F.lit(" value"))).otherwise(F.lit(""))
                            .alias("meaning"))
    order = named.select("db_id", F.col("table_name").alias("table"), F.col("column_name").alias("column"), "col_idx")
    return L.column_meaning_block(links, meanings, order)


HIGHLIGHT_SQL = f"""
with {CAT}, {FK}, {LINK},
j as (select l.question_id, l."table", l."column", n.col_idx, n.table_idx from links l
      join named n on l.db_id = n.db_id and l."table" = n.table_name and l."column" = n.column_name),
pt as (select question_id, table_idx, "table",
  string_agg(concat({QI.format('"table"')}, '.', {QI.format('"column"')}), chr(39) || ', ' || chr(39)
             order by col_idx) as cs
  from j group by 1, 2, 3),
txt as (select question_id, string_agg(concat('### Table: ', "table", chr(10), '[', chr(39), cs, chr(39), ']'),
                                       chr(10) || chr(10) order by table_idx) as highlighted_schema from pt group by 1),
fkm as (select db_id, concat(src_table, '.', src_column) as src,
               arg_max(concat(tgt_table, '.', tgt_column), fk_pos) as tgt from fk group by 1, 2),
fke as (select l.question_id, concat(chr(39), f.src, chr(39), ': ', chr(39), f.tgt, chr(39)) as e
        from links l join fkm f on l.db_id = f.db_id and concat(l."table", '.', l."column") = f.src),
fks as (select question_id, string_agg(e, ', ' order by e) as e from fke group by 1),
ids as (select distinct question_id from links)
select ids.question_id, coalesce(highlighted_schema, '') as highlighted_schema,
  concat('{{', coalesce(fks.e, ''), '}}') as foreign_keys
from ids left join txt on ids.question_id = txt.question_id left join fks on ids.question_id = fks.question_id"""


@register("highlighted_schema", "Q17 C4 D13 D14", sql=HIGHLIGHT_SQL)
def highlighted_schema(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    corpus = fixtures.load(spark, sf_dir, "sql_corpus")
    named = K.named_columns(cat)
    links = L.link_schema(corpus, named, carry=("db_id",))
    _, fk_map = K.key_maps(cat)
    return L.highlighted_schema(links, named, fk_map)


# --- sample rows --------------------------------------------------------------

# Given tables by their key; whole-number, text and date columns, as both engines print these alike.
SAMPLED = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
    "lineitem": "l_orderkey l_linenumber l_partkey l_returnflag", "events": "event_id user_id event_type",
    "documents": "doc_id lang source n_chars", "embeddings": "vec_id label", "pages": "page_id url",
    "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role",
}
ORDER = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"], "conversations": ["conv_id", "turn"]}
BUDGET, RESERVE = 700, 60  # small enough that walks of this catalog overflow it


def _sample_sql(name):
    cols = SAMPLED[name].split()
    order = ", ".join(ORDER.get(name, cols[:1]))
    obj = ", ".join(f"{c} := {c}" for c in cols)
    return (f"(select '{name}' as table_name, '{','.join(cols)}' as columns, "
            f"cast(to_json(struct_pack({obj})) as varchar) as sample from {name} order by {order} limit 1)")


SAMPLES_SQL = " union all ".join(f"select * from {_sample_sql(n)}" for n in SAMPLED)


def _samples(spark, sf_dir):
    from qcorpus.sources.catalog import sample_rows as sr
    return sr({n: table(spark, sf_dir, n).select(*c.split()) for n, c in SAMPLED.items()}, ORDER)


# --- walks ------------------------------------------------------------------

def _walk_step(k, prev):
    active = f"({k} <= depth - 1 and not stopped)"
    has = "coalesce(len(nbrs), 0) > 0"
    pick = f"nbrs[((walk_id * 7919 + {k * 104729 + 42}) % len(nbrs)) + 1]"
    return f"""w{k} as (select walk_id, db_id,
  case when {active} and {has} then {pick} else curr end as curr,
  case when {active} and {has} and not list_contains(path, {pick}) then list_append(path, {pick}) else path end as path,
  depth, stopped or ({active} and not ({has})) as stopped
  from {prev} left join nb using (db_id, curr))"""


WALKS = f"""sql_corpus as ({fixtures.SQL_CORPUS_SQL}),
tl as (select db_id, list(table_name order by table_idx) as tables from cat_tables group by 1),
nb as (select db_id, src as curr, list(tgt order by tgt) as nbrs from edges group by 1, 2),
w0 as (select question_id as walk_id, s.db_id, tables[((question_id * 31) % len(tables)) + 1] as curr,
  [tables[((question_id * 31) % len(tables)) + 1]] as path, 2 + question_id % 3 as depth, false as stopped
  from sql_corpus s join tl on s.db_id = tl.db_id),
{_walk_step(1, 'w0')},
{_walk_step(2, 'w1')},
{_walk_step(3, 'w2')},
walks as (select walk_id, db_id, path, depth from w3 where len(path) >= 2)"""


def _walks(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    starts = fixtures.load(spark, sf_dir, "sql_corpus").select(F.col("question_id").alias("walk_id"), "db_id")
    return cat, W.random_walks(starts, cat.tables, K.fk_edges(cat))


@register("random_walks", "C11", sql=f"""
with {CAT}, {FK}, {WALKS}
select walk_id, db_id, array_to_string(path, ',') as path, cast(depth as bigint) as depth,
  cast(len(path) as bigint) as length from walks""")
def random_walks(spark, sf_dir):
    _, w = _walks(spark, sf_dir)
    return w.select("walk_id", "db_id", F.array_join("path", ",").alias("path"),
                    F.col("depth").cast("bigint").alias("depth"), F.size("path").cast("bigint").alias("length"))


@register("pack_budget", "E4 C2", sql=f"""
with {CAT}, {FK}, {WALKS}, {DESC_SQL},
smp as (select table_name, chr(10) || '  Sample: ' || columns || ' -> ' || sample as line from ({SAMPLES_SQL})),
described as (select n.db_id, n.col_idx, n.table_name, n.column_name, coalesce(d.description, '') as description
  from named n left join (select lower(concat("table", '.', "column")) as key, max(description) as description
                          from descs group by 1) d on lower(concat(n.table_name, '.', n.column_name)) = d.key),
tdesc as (select db_id, table_name, concat('Table ''', table_name, ''' columns: [',
  string_agg(case when description <> '' then concat(column_name, ' (', description, ')') else column_name end,
             ', ' order by col_idx), ']', coalesce(any_value(smp.line), '')) as schema_str
  from described left join smp using (table_name) group by 1, 2),
steps as (select walk_id, db_id, unnest(path) as table_name, generate_subscripts(path, 1) as pos from walks),
j as (select s.walk_id, s.pos, t.schema_str,
  coalesce(sum(length(t.schema_str) + 2) over (partition by s.walk_id order by s.pos
           rows between unbounded preceding and 1 preceding), 0) as before
  from steps s join tdesc t on s.db_id = t.db_id and s.table_name = t.table_name),
stops as (select walk_id, min(pos) as pos from j where before + length(schema_str) + {RESERVE} > {BUDGET} group by 1),
kept as (select j.* from j left join stops using (walk_id) where stops.pos is null or j.pos < stops.pos),
texts as (select walk_id, count(*) as n, substr(string_agg(schema_str, chr(10) || chr(10) order by pos), 1, {BUDGET}) as x
  from kept group by 1)
select walks.walk_id, coalesce(n, 0) as kept_tables, md5(coalesce(x, '')) as context_md5
from walks left join texts using (walk_id)""")
def pack_budget(spark, sf_dir):
    cat, w = _walks(spark, sf_dir)
    desc = W.table_descriptions(K.describe_columns(cat, derived_descriptions(cat)), cat.tables, _samples(spark, sf_dir))
    out = W.pack_budget(w, desc, limit=BUDGET, reserve=RESERVE)
    return out.select("walk_id", "kept_tables", F.md5("context").alias("context_md5"))


@register("assign_round_robin", "E3", sql=f"""
with {CAT}, sql_corpus as ({fixtures.SQL_CORPUS_SQL}),
d as (select db_id, row_number() over (order by db_id) - 1 as pos from cat_db),
i as (select question_id, row_number() over (order by question_id) as seq from sql_corpus)
select question_id, d.db_id as assigned_db from i join d on (i.seq - 1) % (select count(*) from d) = d.pos""")
def assign_round_robin(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    items = fixtures.load(spark, sf_dir, "sql_corpus").select("question_id")
    return W.assign_round_robin(items, "question_id", cat.tables.select("db_id"))


@register("sample_rows", "A5", sql=SAMPLES_SQL)
def sample_rows(spark, sf_dir):
    return _samples(spark, sf_dir)
