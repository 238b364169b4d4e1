"""Schema graph operators over a flattened catalog.

Catalog tables are dimension-sized (one row per database table/column);
joins from corpus-sized tables onto them are equi-joins on ``db_id`` that
Catalyst/AQE turn into broadcast hash joins when the catalog is small,
and into shuffled joins when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qcorpus.functions.text import quote_ident
from qcorpus.sources.catalog import Catalog


def named_columns(cat: Catalog) -> DataFrame:
    """Columns with their table name: db_id, col_idx, table_idx, table_name, column_name
    (the name is resolved while flattening; older flat tables are joined)."""
    if "table_name" in cat.columns.columns:
        return cat.columns.select("db_id", "table_idx", "col_idx", "column_name", "table_name")
    return cat.columns.join(cat.tables, ["db_id", "table_idx"], "inner")


def resolve_foreign_keys(cat: Catalog) -> DataFrame:
    """Foreign keys by column position -> (src_table, src_column,
    tgt_table, tgt_column); keys with an unknown end are dropped."""
    cols = named_columns(cat)
    s = cols.select("db_id", F.col("col_idx").alias("src_col_idx"), F.col("table_name").alias("src_table"),
                    F.col("column_name").alias("src_column"))
    t = cols.select("db_id", F.col("col_idx").alias("tgt_col_idx"), F.col("table_name").alias("tgt_table"),
                    F.col("column_name").alias("tgt_column"))
    return cat.foreign_keys.join(s, ["db_id", "src_col_idx"]).join(t, ["db_id", "tgt_col_idx"]) \
              .select("db_id", "fk_pos", "src_table", "src_column", "tgt_table", "tgt_column")


def fk_edges(cat: Catalog) -> DataFrame:
    """G1: table-to-table edges, each foreign key in both directions,
    duplicates collapsed: db_id, src, tgt."""
    fk = resolve_foreign_keys(cat)
    a = fk.select("db_id", F.col("src_table").alias("src"), F.col("tgt_table").alias("tgt"))
    b = fk.select("db_id", F.col("tgt_table").alias("src"), F.col("src_table").alias("tgt"))
    return a.union(b).distinct()


def schema_graph(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the schema graph.  Nodes: ``db.table`` (type
    table) and ``db.table.column`` (type column).  Edges: containment
    table -> column and foreign-key table -> table, with a relation tag."""
    cols = named_columns(cat)
    tnode = F.concat_ws(".", "db_id", "table_name")
    cnode = F.concat_ws(".", "db_id", "table_name", "column_name")
    nodes = cat.tables.select(tnode.alias("node"), F.lit("table").alias("type"), "db_id") \
        .unionByName(cols.select(cnode.alias("node"), F.lit("column").alias("type"), "db_id"))
    contain = cols.select("db_id", tnode.alias("src"), cnode.alias("dst"),
                          F.lit("type_2_containment").alias("relation"))
    fk = fk_edges(cat).select("db_id", F.concat_ws(".", "db_id", "src").alias("src"),
                              F.concat_ws(".", "db_id", "tgt").alias("dst"), F.lit("type_3_fk").alias("relation"))
    return nodes.distinct(), contain.unionByName(fk).distinct()


def graph_counts(cat: Catalog) -> DataFrame:
    """Number of nodes and of distinct edges."""
    nodes, edges = schema_graph(cat)
    n_nodes = nodes.select("node").distinct().select(F.count(F.lit(1))).scalar()
    n_edges = edges.select("src", "dst").distinct().select(F.count(F.lit(1))).scalar()
    return nodes.sparkSession.range(1).select(n_nodes.alias("nodes"), n_edges.alias("edges"))


def describe_columns(cat: Catalog, descriptions: DataFrame, by_database: bool = False) -> DataFrame:
    """Every column with its description looked up by
    ``lower(table.column)`` (default ``""``).  ``descriptions`` has
    ``table, column, description`` (and ``file_path``/``db_folder`` from
    :func:`read_column_descriptions`).  Equal keys keep the last by
    ``file_path``: the key has no database, so equal names in two databases
    overwrite each other (quirk Q8).  ``by_database=True`` keys by
    ``db_folder`` = ``db_id`` as well."""
    keys = [F.lower(F.concat_ws(".", "table", "column")).alias("key")]
    if by_database:
        keys.append(F.col("db_folder").alias("db_id"))
    d = descriptions.select(*keys, "description", *(["file_path"] if "file_path" in descriptions.columns else []))
    gk = ["key", "db_id"] if by_database else ["key"]
    if "file_path" in d.columns:
        d = d.groupBy(*gk).agg(F.max_by("description", "file_path").alias("description"))
    else:
        d = d.groupBy(*gk).agg(F.max("description").alias("description"))
    cols = named_columns(cat).withColumn("key", F.lower(F.concat_ws(".", "table_name", "column_name")))
    return cols.join(d, gk, "left").withColumn("description", F.coalesce("description", F.lit(""))).drop("key")


def schema_text(cat: Catalog) -> DataFrame:
    """Per database, blocks ``### Table: T`` + the Python-style list of
    ``table.column`` entries (names with a space back-quoted), in catalog
    order, blank line between; tables without columns keep ``[]``."""
    cols = named_columns(cat)
    entry = F.concat(quote_ident(F.col("table_name")), F.lit("."), quote_ident(F.col("column_name")))
    per_table = cols.groupBy("db_id", "table_idx").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", entry.alias("e")))).alias("cs"))
    lst = F.when(F.size("cs") > 0, F.concat(F.lit("['"), F.array_join(F.transform("cs", lambda x: x["e"]), "', '"),
                                            F.lit("']"))).otherwise(F.lit("[]"))
    blocks = cat.tables.join(per_table, ["db_id", "table_idx"], "left") \
        .withColumn("cs", F.coalesce("cs", F.array().cast("array<struct<col_idx:int,e:string>>"))) \
        .select("db_id", "table_idx", F.concat(F.lit("### Table: "), F.col("table_name"), F.lit("\n"), lst).alias("b"))
    return blocks.groupBy("db_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_idx", "b"))), lambda x: x["b"]),
                     "\n\n").alias("schema_text"))


def attach_schema(items: DataFrame, schemas: DataFrame, db_col: str = "db_id") -> DataFrame:
    """Each item with its database's schema text (``""`` and
    ``has_schema = false`` for unknown databases)."""
    from qcorpus.session import broadcast_if_small
    side = schemas.withColumnRenamed("db_id", db_col).withColumn("__known", F.lit(True))
    j = items.join(broadcast_if_small(side), db_col, "left")
    return j.withColumn("has_schema", F.coalesce("__known", F.lit(False))) \
            .withColumn("schema_text", F.coalesce("schema_text", F.lit(""))).drop("__known")


def key_maps(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """(primary-key map rows ``db_id, table, pk_columns``; foreign-key
    map rows ``db_id, src, tgt``).  A table named by several key entries
    keeps the last; a source column with several targets keeps the last."""
    cols = named_columns(cat)
    pk = cat.primary_keys.join(cols, ["db_id", "col_idx"], "inner")
    # the table of a key entry is the table of its first column
    first = pk.filter(F.col("key_pos") == 0).select("db_id", "pk_pos", F.col("table_name").alias("pk_table"))
    per_entry = pk.join(first, ["db_id", "pk_pos"]).groupBy("db_id", "pk_pos", "pk_table").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key_pos", "column_name"))),
                                 lambda x: x["column_name"]), ",").alias("pk_columns"))
    pk_map = per_entry.groupBy("db_id", F.col("pk_table").alias("table")) \
                      .agg(F.max_by("pk_columns", "pk_pos").alias("pk_columns"))
    fk = resolve_foreign_keys(cat)
    fk_map = fk.groupBy("db_id", F.concat_ws(".", "src_table", "src_column").alias("src")) \
               .agg(F.max_by(F.concat_ws(".", "tgt_table", "tgt_column"), "fk_pos").alias("tgt"))
    return pk_map, fk_map
