"""Random walks over foreign-key edges and prompt budgets.

A walk is a row; it meets its database's row (table list and neighbour
map, dimension-sized) in one join, and each move is an expression over that
map, with no iteration on the driver over rows.  The random choice
is an arithmetic function of the walk id and step, so results do not depend
on partitioning and can be repeated by any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the arithmetic pick (see FIXTURES): start, depth and move.
START_MUL = 31
MOVE_MUL, STEP_MUL, SEED = 7919, 104729, 42
DEPTHS = (2, 3, 4)
MAX_PROMPT_LENGTH = 8000
PROMPT_RESERVE = 500


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Sorted neighbour names per (db_id, table) from ``db_id, src, tgt``."""
    return edges.groupBy("db_id", F.col("src").alias("curr")).agg(F.sort_array(F.collect_set("tgt")).alias("nbrs"))


def table_lists(tables: DataFrame) -> DataFrame:
    """Tables of each database in catalog order."""
    return tables.groupBy("db_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("table_idx", "table_name"))),
                    lambda x: x["table_name"]).alias("tables"))


def database_walk_info(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per database: its tables in catalog order and a map from
    each table to its sorted neighbour list (dimension-sized)."""
    nb = neighbour_lists(edges).groupBy("db_id").agg(
        F.map_from_entries(F.collect_list(F.struct("curr", "nbrs"))).alias("nbr_map"))
    return table_lists(tables).join(nb, "db_id", "left")


def random_walks(starts: DataFrame, tables: DataFrame, edges: DataFrame, walk_col: str = "walk_id",
                 min_length: int = 2) -> DataFrame:
    """C11: one walk per row of ``starts`` (walk id, db_id).

    Start table ``tables[walk*31 mod n]``; target depth ``2 + walk mod 3``;
    move k picks ``nbrs[(walk*7919 + k*104729 + 42) mod len]``; no neighbour
    stops the walk; a revisited table moves the walker but is not appended.
    Walks shorter than ``min_length`` are dropped.

    Each walk meets its database's row once (table list + neighbour map,
    materialised and broadcast after a size check); the moves are then plain
    expressions over that map, so the walks table is joined once and never
    shuffled."""
    from qcorpus.session import broadcast_if_small, cut_lineage
    w = F.col(walk_col)
    info = broadcast_if_small(cut_lineage(database_walk_info(tables, edges)))
    walks = starts.select(walk_col, "db_id").join(info, "db_id", "inner")
    first = F.element_at("tables", (F.pmod(w * START_MUL, F.size("tables")) + 1).cast("int"))
    depth = F.lit(DEPTHS[0]) + F.pmod(w, F.lit(len(DEPTHS)))
    init = F.struct(first.alias("curr"), F.array(first).alias("path"), F.lit(False).alias("stopped"))

    def move(acc, k):
        # the walker state is a lambda variable: each move reads it once,
        # so chaining moves does not grow the expression
        nbrs = F.element_at(F.col("nbr_map"), acc["curr"])
        active = (k <= depth - 1) & ~acc["stopped"]
        has = F.coalesce(F.size(nbrs), F.lit(0)) > 0
        pick = F.element_at(nbrs, (F.pmod(w * MOVE_MUL + k * STEP_MUL + SEED, F.size(nbrs)) + 1).cast("int"))
        return F.struct(
            F.when(active & has, pick).otherwise(acc["curr"]).alias("curr"),
            F.when(active & has & ~F.array_contains(acc["path"], pick), F.array_append(acc["path"], pick))
             .otherwise(acc["path"]).alias("path"),
            (acc["stopped"] | (active & ~has)).alias("stopped"))

    steps = F.sequence(F.lit(1), F.lit(max(DEPTHS) - 1))
    walked = walks.select(walk_col, "db_id", depth.alias("depth"), F.aggregate(steps, init, move)["path"].alias("path"))
    return walked.filter(F.size("path") >= min_length).select(walk_col, "db_id", "path", "depth")


def assign_round_robin(items: DataFrame, order_col: str, dbs: DataFrame, out_col: str = "assigned_db") -> DataFrame:
    """Items in ``order_col`` order assigned to databases in turn
    (``dbs`` has db_id; cycled in db_id order)."""
    from qcorpus.operators.ranking import global_row_number
    ranked = global_row_number(items, order_col, "__seq")
    d = dbs.select("db_id").distinct()
    n = d.select(F.count(F.lit(1))).scalar()
    from qcorpus.session import broadcast_if_small, cut_lineage
    # sorted by sampled ranges; a row's position is the rows of the ranges before it and its place in its own
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(d.repartitionByRange(tasks, "db_id").sortWithinPartitions("db_id")
                          .withColumn("__id", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__id", 33))
    starts = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offsets = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")) \
        .withColumn("__before", F.coalesce(F.sum("__n").over(starts), F.lit(0))).drop("__n")
    dpos = ordered.join(F.broadcast(offsets), "__range") \
        .select("db_id", (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("__pos"))
    return ranked.withColumn("__pos", F.pmod(F.col("__seq") - 1, n)) \
                 .join(broadcast_if_small(dpos.withColumnRenamed("db_id", out_col)), "__pos", "inner") \
                 .drop("__pos", "__seq")


def table_descriptions(described_columns: DataFrame, tables: DataFrame | None = None,
                       samples: DataFrame | None = None) -> DataFrame:
    """Per (db_id, table): ``Table 'T' columns: [c1 (desc), c2, ...]`` in
    column order (a description is appended in parentheses when non-empty).
    With ``tables`` (db_id, table_name), tables without columns get ``[]``.
    With ``samples`` (table_name, columns, sample: one row per table, see
    ``sample_rows``) a line ``Sample: columns -> row`` follows, and counts in
    every length test."""
    col_str = F.when(F.col("description") != "", F.concat("column_name", F.lit(" ("), "description", F.lit(")"))) \
               .otherwise(F.col("column_name"))
    g = described_columns.groupBy("db_id", "table_name").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", col_str.alias("c")))).alias("cs"))
    if tables is not None:
        g = tables.select("db_id", "table_name").join(g, ["db_id", "table_name"], "left")
    cs = F.coalesce(F.transform("cs", lambda x: x["c"]), F.array().cast("array<string>"))
    text = F.concat(F.lit("Table '"), F.col("table_name"), F.lit("' columns: ["), F.array_join(cs, ", "), F.lit("]"))
    if samples is not None:
        g = g.join(samples.select("table_name", "columns", "sample"), "table_name", "left")
        text = F.concat(text, F.coalesce(F.concat(F.lit("\n  Sample: "), F.col("columns"), F.lit(" -> "), F.col("sample")),
                                         F.lit("")))
    return g.select("db_id", "table_name", text.alias("schema_str"))


def pack_budget(walks: DataFrame, table_desc: DataFrame, walk_col: str = "walk_id",
                limit: int = MAX_PROMPT_LENGTH, reserve: int = PROMPT_RESERVE) -> DataFrame:
    """Per walk, keep the path's tables in order while
    ``chars + len + reserve <= limit`` (chars grows by len + 2 per kept
    table, stop at the first overflow); the context is the kept texts joined
    by a blank line, cut at ``limit``.  A walk whose first table does not fit
    keeps an empty context.

    Each database's table texts become one map (a dimension-sized row per
    database, joined onto the walks by ``db_id``); the budget is then a fold
    over the walk's own path, so the walks are never exploded or shuffled."""
    from qcorpus.session import broadcast_if_small
    maps = table_desc.groupBy("db_id").agg(
        F.map_from_entries(F.collect_list(F.struct("table_name", "schema_str"))).alias("__descs"))
    j = walks.join(broadcast_if_small(maps), "db_id", "left")
    texts = F.filter(F.transform("path", lambda t: F.element_at(F.col("__descs"), t)), lambda x: x.isNotNull())
    init = F.struct(F.lit(0).alias("chars"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("stop"))

    def step(acc, s):
        fits = ~acc["stop"] & (acc["chars"] + F.length(s) + reserve <= limit)
        return F.when(fits, F.struct((acc["chars"] + F.length(s) + 2).alias("chars"),
                                     F.array_append(acc["kept"], s).alias("kept"), F.lit(False).alias("stop"))) \
                .otherwise(F.struct(acc["chars"].alias("chars"), acc["kept"].alias("kept"), F.lit(True).alias("stop")))

    kept = F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), init, step)["kept"]
    return j.select(walk_col, F.size(kept).cast("bigint").alias("kept_tables"),
                    F.substring(F.array_join(kept, "\n\n"), 1, limit).alias("context"))
