"""Catalog and column-description sources (A3, A4, A5).

The nested catalog (one JSON object per database with positional
references) is flattened into four relational tables with ``posexplode``;
everything downstream joins on ``(db_id, position)`` keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("db_id STRING, table_names_original ARRAY<STRING>, "
                  "column_names_original ARRAY<ARRAY<STRING>>, primary_keys ARRAY<STRING>, "
                  "foreign_keys ARRAY<ARRAY<INT>>")


@dataclass
class Catalog:
    tables: DataFrame        # db_id, table_idx, table_name
    columns: DataFrame       # db_id, col_idx, table_idx, column_name, table_name
    primary_keys: DataFrame  # db_id, pk_pos, key_pos, col_idx
    foreign_keys: DataFrame  # db_id, fk_pos, src_col_idx, tgt_col_idx


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """A4 (source): the catalog file, a JSON array of databases.  Mixed-type
    fields are read as text: ``[-1, "*"]`` becomes ``["-1", "*"]`` and a
    primary key is ``"3"`` or ``"[3,4]"``."""
    return spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)


def flatten_catalog(nested: DataFrame) -> Catalog:
    """A4: nested catalog rows -> four flat tables; column entry 0
    (``[-1, "*"]``) is skipped, composite primary keys are exploded with
    their position."""
    tables = nested.select("db_id", F.posexplode("table_names_original").alias("table_idx", "table_name"))
    cols = nested.select("db_id", "table_names_original",
                         F.posexplode("column_names_original").alias("col_idx", "c"))
    tidx = F.col("c")[0].cast("int")
    # the table name is looked up in the same nested row (no join); an
    # index outside the table list has no name and the column is dropped
    cols = cols.select("db_id", "col_idx", tidx.alias("table_idx"), F.col("c")[1].alias("column_name"),
                       F.try_element_at("table_names_original", tidx + 1).alias("table_name")) \
               .filter((F.col("table_idx") != -1) & F.col("table_name").isNotNull())
    pks = nested.select("db_id", F.posexplode("primary_keys").alias("pk_pos", "pk"))
    as_list = F.when(F.trim("pk").startswith("["), F.from_json("pk", "array<int>")) \
               .otherwise(F.array(F.col("pk").cast("int")))
    pks = pks.select("db_id", "pk_pos", F.posexplode(as_list).alias("key_pos", "col_idx"))
    fks = nested.select("db_id", F.posexplode("foreign_keys").alias("fk_pos", "fk"))
    fks = fks.select("db_id", "fk_pos", F.col("fk")[0].alias("src_col_idx"), F.col("fk")[1].alias("tgt_col_idx"))
    return Catalog(tables, cols, pks, fks)


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """A4: read and flatten a catalog file."""
    return flatten_catalog(read_catalog_json(spark, path))


def read_column_descriptions(spark: SparkSession, root: str) -> DataFrame:
    """A3: every ``*.csv`` below ``root`` (Latin-1, header row), one row per
    described column: ``db_folder, table, column, description, file_path``.

    The table name is the file name without ``.csv``; the column name comes
    from ``original_column_name`` else ``Field``, the text from
    ``column_description`` else ``Description``.  Files have different
    headers: one Spark pass reads each file's first line (file listing and
    header text are metadata-sized), files are grouped by header, each group
    is read as CSV and the groups are combined with
    ``unionByName(allowMissingColumns=True)``.  Missing cells are null, not
    the text ``nan`` (quirk Q9); rows with an empty column name are dropped.
    Quoted cells may hold line breaks and doubled quotes; a row with fewer or
    more cells than its header stays, with nulls or without the surplus.
    """
    @F.pandas_udf("string")
    def header(contents):
        import csv
        import io
        import json

        def first(data):
            return json.dumps(next(csv.reader(io.StringIO(bytes(data).decode("latin-1"), newline="")), []))
        return contents.map(first)

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.csv").load(root).select("path", header("content").alias("header")))
    groups: dict[str, list[str]] = {}
    for r in files.collect():  # one header row per file
        groups.setdefault(r["header"], []).append(r["path"])
    parts = []
    for paths in groups.values():
        parts.append(spark.read.option("header", True).option("encoding", "ISO-8859-1")
                     .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(paths)
                     .withColumn("__path", F.col("_metadata.file_path"))
                     .withColumn("__name", F.col("_metadata.file_name")))
    if not parts:
        return spark.createDataFrame([], "db_folder string, table string, column string, description string, "
                                         "file_path string")
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    have = set(raw.columns)

    def pick(*names):
        cs = [F.col(f"`{n}`") for n in names if n in have]
        return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cs]) if cs else F.lit(None).cast("string")

    path = F.url_decode(F.col("__path"))  # the metadata path is URL-encoded
    out = raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("db_folder"),
        F.regexp_replace(F.url_decode(F.col("__name")), r"\.csv$", "").alias("table"),
        F.trim(pick("original_column_name", "Field")).alias("column"),
        F.trim(F.coalesce(pick("column_description", "Description"), F.lit(""))).alias("description"),
        path.alias("file_path"),
    )
    return out.filter(F.coalesce(F.col("column"), F.lit("")) != "")


def sample_rows(tables: dict[str, DataFrame], key: dict[str, str | list[str]] | None = None) -> DataFrame:
    """A5: one sample row per table as JSON with its column names.  The row
    is the smallest by the table's key (the reference takes whichever row
    comes first; ordering is our choice for reproducibility).  ``orderBy +
    limit(1)`` runs as a TakeOrdered: each task keeps one row."""
    key = key or {}
    outs = []
    for name, df in tables.items():
        k = key.get(name, df.columns[0])
        row = df.orderBy(*([k] if isinstance(k, str) else k)).limit(1)
        outs.append(row.select(F.lit(name).alias("table_name"),
                               F.lit(",".join(df.columns)).alias("columns"),
                               F.to_json(F.struct(*df.columns)).alias("sample")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out
