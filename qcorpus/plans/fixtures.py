"""Tables derived from the given parquet tables.

The given tables hold no SQL text, model output or catalog, so the corpus
tables every operator works on are *derived* from them, row for row: one
corpus row per order, one attempt per event, one model output per document,
one database per corpus ``db_id``.  Each builder has a Spark form (used by the
registered queries) and the equal DuckDB SQL (used as the oracle's CTE).
Work therefore grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qcorpus.session import spread, table

NL = "\n"
FENCE = "```"


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---------------------------------------------------------------------------
# sql_corpus: one (question, SQL, status) row per order
# ---------------------------------------------------------------------------

def sql_corpus(orders: DataFrame) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    k = key % 8
    sql = (
        F.when(k == 0, F.concat(F.lit("SELECT o_totalprice FROM orders WHERE o_orderkey = "), _s(key)))
        .when(k == 1, F.concat(F.lit("SELECT c_name FROM customer WHERE c_mktsegment IN ('"),
                               F.col("o_orderpriority"), F.lit("')")))
        .when(k == 2, F.lit("SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus"))
        .when(k == 3, F.concat(
            F.lit("SELECT n_name, AVG(c_acctbal) FROM customer INNER JOIN nation ON c_nationkey = n_nationkey "
                  "WHERE c_acctbal BETWEEN 0 AND "), _s(cust), F.lit(" GROUP BY n_name HAVING COUNT(*) > 2")))
        .when(k == 4, F.concat(F.lit("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT "), _s(cust)))
        .when(k == 5, F.lit("SELECT \"in\" FROM `between` WHERE x = 'like'"))
        .when(k == 6, F.lit(""))
        .otherwise(F.lit("hello world"))
    )
    status = (F.when(cust % 5 == 0, F.lit(None).cast("string"))
              .when(cust % 5 == 1, "invalid_quality")
              .when(cust % 5 == 2, "judge_failed")
              .otherwise("valid_quality"))
    return orders.select(
        key.alias("question_id"),
        F.concat(F.lit("db_"), _s(F.floor(cust / 10))).alias("db_id"),
        F.concat(F.lit("What is recorded for order "), _s(key), F.lit("?")).alias("question"),
        sql.alias("sql"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


SQL_CORPUS_SQL = """
select o_orderkey as question_id,
  concat('db_', cast(o_custkey // 10 as varchar)) as db_id,
  concat('What is recorded for order ', cast(o_orderkey as varchar), '?') as question,
  case o_orderkey % 8
    when 0 then concat('SELECT o_totalprice FROM orders WHERE o_orderkey = ', cast(o_orderkey as varchar))
    when 1 then concat('SELECT c_name FROM customer WHERE c_mktsegment IN (''', o_orderpriority, ''')')
    when 2 then 'SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus'
    when 3 then concat('SELECT n_name, AVG(c_acctbal) FROM customer INNER JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND ',
                       cast(o_custkey as varchar), ' GROUP BY n_name HAVING COUNT(*) > 2')
    when 4 then concat('SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT ', cast(o_custkey as varchar))
    when 5 then 'SELECT "in" FROM `between` WHERE x = ''like'''
    when 6 then '' else 'hello world' end as sql,
  case o_custkey % 5 when 0 then null when 1 then 'invalid_quality' when 2 then 'judge_failed'
       else 'valid_quality' end as status,
  o_orderdate as created_at
from orders
"""


# ---------------------------------------------------------------------------
# attempts: four attempts per item, one per event
# ---------------------------------------------------------------------------

def attempts(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    item = F.floor(eid / 4).cast("bigint")
    t = item % 4
    u = uid % 6
    return events.select(
        item.alias("item_id"),
        (eid % 4 + 1).cast("bigint").alias("attempt"),
        F.when(t == 0, "simple").when(t == 1, "conditional").when(t == 2, "aggregation")
        .otherwise("complex").alias("target"),
        F.when(u == 0, "simple").when(u == 1, "conditional").when(u == 2, "aggregation")
        .when(u == 3, "complex").when(u == 4, F.lit(None).cast("string")).otherwise("parse_error").alias("cls"),
        F.col("ts"),
    )


ATTEMPTS_SQL = """
select event_id // 4 as item_id,
  cast(event_id % 4 + 1 as bigint) as attempt,
  case (event_id // 4) % 4 when 0 then 'simple' when 1 then 'conditional' when 2 then 'aggregation'
       else 'complex' end as target,
  case user_id % 6 when 0 then 'simple' when 1 then 'conditional' when 2 then 'aggregation'
       when 3 then 'complex' when 4 then null else 'parse_error' end as cls,
  ts
from events
"""


# ---------------------------------------------------------------------------
# model_outputs: one raw model answer per document, five shapes by doc_id % 5,
# each carrying the document's whole text
# ---------------------------------------------------------------------------

def model_outputs(documents: DataFrame) -> DataFrame:
    d, n, src, text = F.col("doc_id"), F.col("n_chars"), F.col("source"), F.col("text")
    k = d % 5
    out = (
        F.when(k == 0, F.concat(F.lit("<think>"), text, F.lit("</think>" + NL + FENCE + "SR" + NL +
                                "df1 = df.where(element = documents.n_chars, filter = "), _s(n),
                                F.lit(")" + NL + FENCE)))
        .when(k == 1, F.concat(text, F.lit(NL + "df1 = t.yr + t.id "), _s(d), F.lit(NL + FENCE)))
        .when(k == 2, F.concat(text, F.lit(NL + FENCE + "sql" + NL +
                                           "SELECT n_chars FROM documents WHERE doc_id = "), _s(d),
                               F.lit(";" + NL + FENCE + NL + "Explanation: the count")))
        .when(k == 3, F.concat(F.lit("Answer: "), text, F.lit(" {\"question\": \"How long is document "), _s(d),
                               F.lit("?\", \"sql\": \"SELECT n_chars FROM documents WHERE source = '"), src,
                               F.lit("'\", \"evidence\": \"n_chars is the length\", \"is_correct\": "),
                               F.when(d % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
                               F.lit(", \"reasoning\": \"length column\"} Note: done")))
        .otherwise(F.concat(F.lit("  "), text, F.lit("  ")))
    )
    return documents.select(d.alias("doc_id"), out.alias("output"), src.alias("source"), n.alias("n_chars"))


MODEL_OUTPUTS_SQL = r"""
select doc_id,
  case doc_id % 5
    when 0 then concat('<think>', text, '</think>', chr(10), '```SR', chr(10),
                       'df1 = df.where(element = documents.n_chars, filter = ', cast(n_chars as varchar), ')', chr(10), '```')
    when 1 then concat(text, chr(10), 'df1 = t.yr + t.id ', cast(doc_id as varchar), chr(10), '```')
    when 2 then concat(text, chr(10), '```sql', chr(10), 'SELECT n_chars FROM documents WHERE doc_id = ',
                       cast(doc_id as varchar), ';', chr(10), '```', chr(10), 'Explanation: the count')
    when 3 then concat('Answer: ', text, ' {"question": "How long is document ', cast(doc_id as varchar),
                       '?", "sql": "SELECT n_chars FROM documents WHERE source = ''', source,
                       '''", "evidence": "n_chars is the length", "is_correct": ',
                       case when doc_id % 2 = 0 then 'true' else 'false' end,
                       ', "reasoning": "length column"} Note: done')
    else concat('  ', text, '  ') end as output,
  source, n_chars
from documents
"""


# ---------------------------------------------------------------------------
# sql_pairs: (prediction, gold) per order
# ---------------------------------------------------------------------------

def sql_pairs(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    tmpl_a = F.concat(F.lit("SELECT COUNT(*) FROM t"), _s(key))
    tmpl_b = F.lit("SELECT a FROM b")
    gold = F.when(key % 2 == 0, tmpl_a).otherwise(tmpl_b)
    other = F.when(key % 2 == 0, tmpl_b).otherwise(tmpl_a)
    pred = (F.when(key % 3 == 0, gold)
            .when(key % 3 == 1, F.translate(F.lower(gold), "()", ""))
            .otherwise(other))
    return orders.select(key.alias("pair_id"), pred.alias("pred"), gold.alias("gold"),
                         (F.col("o_totalprice") / 1000.0).alias("latency"))


SQL_PAIRS_SQL = """
select o_orderkey as pair_id,
  case o_orderkey % 3
    when 0 then (case when o_orderkey % 2 = 0 then concat('SELECT COUNT(*) FROM t', cast(o_orderkey as varchar)) else 'SELECT a FROM b' end)
    when 1 then replace(replace(lower(case when o_orderkey % 2 = 0 then concat('SELECT COUNT(*) FROM t', cast(o_orderkey as varchar)) else 'SELECT a FROM b' end), '(', ''), ')', '')
    else (case when o_orderkey % 2 = 0 then 'SELECT a FROM b' else concat('SELECT COUNT(*) FROM t', cast(o_orderkey as varchar)) end) end as pred,
  case when o_orderkey % 2 = 0 then concat('SELECT COUNT(*) FROM t', cast(o_orderkey as varchar)) else 'SELECT a FROM b' end as gold,
  o_totalprice / 1000.0 as latency
from orders
"""


# ---------------------------------------------------------------------------
# catalog: one database per corpus db_id (one per ten customers, so the
# catalog grows with the data), each holding the given tables
# ---------------------------------------------------------------------------

# The tables of a database, their columns in order, primary keys
# (a list means a composite key) and foreign keys (source table.column ->
# target table.column).
CATALOG_TABLES = [
    ("region", ["r_regionkey", "r_name"]),
    ("nation", ["n_nationkey", "n_name", "n_regionkey"]),
    ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
    ("events", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    ("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    ("embeddings", ["vec_id", "embedding", "label"]),
    ("pages", ["page_id", "url", "html"]),
    ("benchmark", ["item_id", "text"]),
    ("labels", ["doc_id", "quality", "toxic"]),
    ("conversations", ["conv_id", "turn", "role", "text"]),
]
CATALOG_PRIMARY_KEYS = [
    "region.r_regionkey", "nation.n_nationkey", "customer.c_custkey", "supplier.s_suppkey",
    "part.p_partkey", "orders.o_orderkey", ["lineitem.l_orderkey", "lineitem.l_linenumber"],
    "events.event_id", "documents.doc_id", "embeddings.vec_id", "pages.page_id",
    "benchmark.item_id", ["conversations.conv_id", "conversations.turn"],
]
CATALOG_FOREIGN_KEYS = [
    ("nation.n_regionkey", "region.r_regionkey"),
    ("customer.c_nationkey", "nation.n_nationkey"),
    ("supplier.s_nationkey", "nation.n_nationkey"),
    ("orders.o_custkey", "customer.c_custkey"),
    ("lineitem.l_orderkey", "orders.o_orderkey"),
    ("lineitem.l_partkey", "part.p_partkey"),
    ("lineitem.l_suppkey", "supplier.s_suppkey"),
    ("labels.doc_id", "documents.doc_id"),
]


def catalog_template() -> dict:
    """The nested catalog entry (without db_id) in the reference's layout:
    column 0 is ``[-1, "*"]``, keys refer to column positions."""
    tables = [t for t, _ in CATALOG_TABLES]
    cols = [["-1", "*"]]
    pos = {}
    for ti, (t, cs) in enumerate(CATALOG_TABLES):
        for c in cs:
            pos[f"{t}.{c}"] = len(cols)
            cols.append([str(ti), c])
    pks = []
    for pk in CATALOG_PRIMARY_KEYS:
        if isinstance(pk, list):
            pks.append("[" + ",".join(str(pos[x]) for x in pk) + "]")
        else:
            pks.append(str(pos[pk]))
    fks = [[pos[s], pos[t]] for s, t in CATALOG_FOREIGN_KEYS]
    return {"table_names_original": tables, "column_names_original": cols,
            "primary_keys": pks, "foreign_keys": fks}


def catalog_extras() -> dict[int, dict]:
    """What databases have besides, by their number modulo 3.  1: a table whose
    names hold spaces, and a key to no column; 2: a table without columns, and a
    second target of a key."""
    t = catalog_template()
    table, column = len(t["table_names_original"]), len(t["column_names_original"])
    pos = {f"{t['table_names_original'][int(a)]}.{c}": k for k, (a, c) in enumerate(t["column_names_original"]) if a != "-1"}
    return {1: {"table_names_original": ["order notes"],
                "column_names_original": [[str(table), c] for c in ("note id", "order key", "note text")],
                "primary_keys": [str(column)],
                "foreign_keys": [[column + 1, pos["orders.o_orderkey"]], [column + 2, 10 * column]]},
            2: {"table_names_original": ["archive"], "column_names_original": [], "primary_keys": [],
                "foreign_keys": [[pos["lineitem.l_suppkey"], pos["part.p_partkey"]]]}}


def catalog(orders: DataFrame) -> DataFrame:
    """Nested catalog, one row per database found in the corpus
    (``db_id, table_names_original, column_names_original, primary_keys,
    foreign_keys``) -- the form ``sources.catalog.read_catalog`` reads."""
    t, extras = catalog_template(), catalog_extras()
    number = F.floor(F.col("o_custkey") / 10)
    dbs = orders.select(F.concat(F.lit("db_"), _s(number)).alias("db_id"), (number % 3).alias("kind")).distinct()

    def nested(field, kind, value):
        def array(values):
            return F.array(*[value(x) for x in values]).cast(kind)
        whole = array(t[field])
        for k, more in extras.items():
            whole = F.when(F.col("kind") == k, array(t[field] + more[field])).otherwise(whole)
        return whole.alias(field)
    text, pair = F.lit, (lambda x: F.array(*[F.lit(v) for v in x]))
    return dbs.select("db_id", nested("table_names_original", "array<string>", text),
                      nested("column_names_original", "array<array<string>>", pair),
                      nested("primary_keys", "array<string>", text), nested("foreign_keys", "array<array<int>>", pair))


def catalog_sql_ctes() -> str:
    """DuckDB CTEs ``cat_db, cat_tables, cat_columns, cat_fks, cat_pks`` equal to the
    flattened :func:`catalog` (flat rows written out from the same fixed values;
    ``only_kind``: the kind of database that has them, or null)."""
    base = catalog_template()
    rows: dict[str, list[str]] = {"t": [], "c": [], "f": [], "p": []}
    at = {field: len(base[field]) for field in base}
    for only, part in [("null", base), *catalog_extras().items()]:
        first = {field: 0 if only == "null" else at[field] for field in base}
        rows["t"] += [f"({i}, '{n}', {only})" for i, n in enumerate(part["table_names_original"], first["table_names_original"])]
        rows["c"] += [f"({i}, {int(a)}, '{b}', {only})" for i, (a, b)
                      in enumerate(part["column_names_original"], first["column_names_original"]) if a != "-1"]
        rows["f"] += [f"({i}, {x}, {y}, {only})" for i, (x, y) in enumerate(part["foreign_keys"], first["foreign_keys"])]
        for i, pk in enumerate(part["primary_keys"], first["primary_keys"]):
            rows["p"] += [f"({i}, {j}, {int(x)}, {only})" for j, x in enumerate(pk.strip("[]").split(","))]
    tables, cols, fks, pks = (", ".join(rows[k]) for k in "tcfp")
    return f"""
cat_db as (select distinct concat('db_', cast(o_custkey // 10 as varchar)) as db_id, o_custkey // 10 % 3 as kind from orders),
cat_t(table_idx, table_name, only_kind) as (values {tables}),
cat_c(col_idx, table_idx, column_name, only_kind) as (values {cols}),
cat_f(fk_pos, src_col_idx, tgt_col_idx, only_kind) as (values {fks}),
cat_p(pk_pos, key_pos, col_idx, only_kind) as (values {pks}),
cat_tables as (select db_id, table_idx, table_name from cat_db, cat_t where coalesce(only_kind, kind) = kind),
cat_columns as (select db_id, col_idx, table_idx, column_name from cat_db, cat_c where coalesce(only_kind, kind) = kind),
cat_fks as (select db_id, fk_pos, src_col_idx, tgt_col_idx from cat_db, cat_f where coalesce(only_kind, kind) = kind),
cat_pks as (select db_id, pk_pos, key_pos, col_idx from cat_db, cat_p where coalesce(only_kind, kind) = kind)"""


# ---------------------------------------------------------------------------
# vectors: one stored vector per embeddings row; queries are vec_id < 20
# ---------------------------------------------------------------------------

N_QUERY_VECTORS = 20


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("vector "), _s("vec_id")).alias("document"),
        F.col("embedding"),
        F.col("label"),
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived fixture by name, read from the given tables in ``sf_dir``."""
    # per-row text work (scoring, extraction, masking) follows these reads,
    # so small inputs are spread over the cores first
    builders = {
        "sql_corpus": lambda: sql_corpus(spread(table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"))),
        "attempts": lambda: attempts(table(spark, sf_dir, "events")),
        "model_outputs": lambda: model_outputs(spread(table(spark, sf_dir, "documents").select(
            "doc_id", "text", "source", "n_chars"))),
        "sql_pairs": lambda: sql_pairs(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))),
        "catalog": lambda: catalog(table(spark, sf_dir, "orders")),
        "vectors": lambda: vectors(table(spark, sf_dir, "embeddings")),
    }
    return builders[name]()
