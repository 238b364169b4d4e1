"""Schema linking (C4-C7): which catalog columns a SQL text mentions.

The table and column names of a database form one Aho-Corasick automaton, built
once per worker; a text meets the names of its own database by one equi-join onto
a table with a row per database and is read once, whatever the number of names.  The
links of a text come back as an array in its row, so nothing is expanded before
it is known to be linked, and no duplicates have to be removed afterwards.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qcorpus.functions.text import quote_ident

_WORD = re.compile("[A-Za-z0-9_]")
FOUND_ROWS = 500


class NameFinder:
    """Finds the tables and columns of one database, JSON pairs, in a text."""

    def __init__(self, names: str):
        self.columns: dict[str, list[str]] = {}
        for pair in json.loads(names):
            table, column = pair if isinstance(pair, list) else (pair.get("table_name"), pair.get("column_name"))
            if table is not None and column is not None:
                self.columns.setdefault(table, []).append(column)
        words = {*self.columns, *(c for cs in self.columns.values() for c in cs)}
        self.always = words & {""}  # an empty name is part of every text
        self.words = words - {""}
        self.automaton = _automaton(self.words)

    def found(self, text: str, whole_word: bool) -> set[str]:
        out = set(self.always)
        if self.automaton is None:
            hits = ((m.end() - 1, w) for w in self.words for m in re.finditer(f"(?={re.escape(w)}).{{{len(w)}}}", text, re.S))
        else:
            hits = self.automaton.iter(text) if self.words else ()
        for end, word in hits:
            if word in out:
                continue
            if whole_word:
                before, after = text[max(end - len(word), 0):end - len(word) + 1], text[end + 1:end + 2]
                if _WORD.match(before) or _WORD.match(after):
                    continue
            out.add(word)
        return out

    def links(self, text: str, star: bool, whole_word: bool) -> list[tuple[str, str]]:
        found = self.found(text, whole_word)
        tables = [t for t in self.columns if t in found]
        out = [(t, c) for t in tables for c in self.columns[t] if c in found]
        return out + [(t, "*") for t in tables] if star and "*" in text else out


def _automaton(words: set[str]):
    try:
        import ahocorasick
    except ImportError:  # names are then searched one by one
        return None
    out = ahocorasick.Automaton()
    for word in words:
        out.add_word(word, word)
    if words:
        out.make_automaton()
    return out


@lru_cache(maxsize=256)
def _finder(names: str) -> NameFinder:
    return NameFinder(names)


def with_links(texts: DataFrame, columns: DataFrame, text_col: str = "sql", out: str = "links", star: bool = False,
               whole_word: bool = False) -> DataFrame:
    """``texts`` (with db_id) and ``out``, the array of distinct (table, column)
    whose column name and table name both occur in the text, case-sensitive
    substring test (quirk Q14; ``whole_word=True`` for word boundaries).  With
    ``star``, ``(table, "*")`` is added for every table named in a text that
    contains ``*``.  ``columns`` has db_id, table_name, column_name; the
    names of one database must fit in a row.  A null text, or one of an unknown
    database, has no links."""
    from qcorpus.session import broadcast_if_small
    kind = pa.list_(pa.struct([("table", pa.string()), ("column", pa.string())]))

    @F.arrow_udf("array<struct<table: string, column: string>>")
    def find(names: pa.Array, bodies: pa.Array) -> pa.Array:
        # the names of a database are one Python text however many rows carry them, and
        # rows are read some at a time, so a task holds little beside the Arrow batch
        coded = names.dictionary_encode()
        known, out = coded.dictionary.to_pylist(), []
        for i in range(0, len(bodies), FOUND_ROWS):
            part = zip(coded.indices.slice(i, FOUND_ROWS).to_pylist(), bodies.slice(i, FOUND_ROWS).to_pylist())
            rows = [[] if k is None or t is None else _finder(known[k]).links(t, star, whole_word) for k, t in part]
            out.append(pa.array([[{"table": t, "column": c} for t, c in r] for r in rows], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    names = columns.groupBy("db_id").agg(F.to_json(F.sort_array(F.collect_set(F.array("table_name", "column_name")))).alias("__names"))
    return (texts.join(broadcast_if_small(names), "db_id", "left").withColumn(out, find("__names", text_col))
            .select(*texts.columns, out))


def link_schema(texts: DataFrame, columns: DataFrame, id_col: str = "question_id", text_col: str = "sql",
                star: bool = False, whole_word: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """C4 (C5 with ``star=True``): a row (id, ``carry``, table, column) per link of
    ``with_links``.  Ids are expected to be unique."""
    linked = with_links(texts, columns, text_col, "__links", star, whole_word)
    return linked.select(id_col, *carry, F.explode("__links").alias("l")).select(id_col, *carry, "l.table", "l.column")


def covers_schema(texts: DataFrame, columns: DataFrame, gold_col: str, candidate_col: str,
                  id_col: str = "question_id") -> DataFrame:
    """Per id, true when every (table, column) linked from the gold SQL
    is also linked from the candidate text (true when gold links nothing)."""
    both = with_links(with_links(texts, columns, gold_col, "__gold"), columns, candidate_col, "__candidate")
    return both.select(id_col, (F.size(F.array_except("__gold", "__candidate")) == 0).alias("covers"))


def column_meaning_block(links: DataFrame, meanings: DataFrame, order: DataFrame,
                         id_col: str = "question_id") -> DataFrame:
    """Per id, lines ``# table.column: meaning`` for linked columns with
    a non-empty meaning (one leading ``#`` dropped), in catalog column
    order, each line ending in a newline.  ``meanings`` has db_id, table,
    column, meaning; ``order`` has db_id, table, column, col_idx; ``links``
    carries db_id."""
    from qcorpus.session import broadcast_if_small
    m = meanings.withColumn("meaning", F.regexp_replace("meaning", "^#", "")) \
                .filter(F.coalesce(F.col("meaning"), F.lit("")) != "")
    dim = m.join(order, ["db_id", "table", "column"], "inner")  # catalog-sized
    j = links.join(broadcast_if_small(dim), ["db_id", "table", "column"], "inner")
    line = F.concat(F.lit("# "), quote_ident(F.col("table")), F.lit("."), quote_ident(F.col("column")),
                    F.lit(": "), F.col("meaning"), F.lit("\n"))
    return j.groupBy(id_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", line.alias("l")))),
                                 lambda x: x["l"]), "").alias("meaning_block"))


def highlighted_schema(links: DataFrame, named_columns: DataFrame, fk_map: DataFrame,
                       id_col: str = "question_id") -> DataFrame:
    """Quirk Q17 filled in: per id, the schema text restricted to its linked
    columns (``### Table: T`` blocks with the Python-style list of
    ``table.column``, catalog order) and the foreign-key slot as a Python
    dict text ``{'t.c': 't.c', ...}`` of keys whose source column is linked
    (``{}`` when none).  ``links`` carries db_id; groups are per id and
    bounded by the width of its database."""
    from qcorpus.session import broadcast_if_small
    j = links.join(broadcast_if_small(named_columns.select("db_id", F.col("table_name").alias("table"),
                                                           F.col("column_name").alias("column"), "col_idx",
                                                           "table_idx")),
                   ["db_id", "table", "column"], "inner")
    entry = F.concat(quote_ident(F.col("table")), F.lit("."), quote_ident(F.col("column")))
    per_table = j.groupBy(id_col, "table_idx", "table").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", entry.alias("e")))).alias("cs"))
    block = F.concat(F.lit("### Table: "), F.col("table"), F.lit("\n['"),
                     F.array_join(F.transform("cs", lambda x: x["e"]), "', '"), F.lit("']"))
    text = per_table.groupBy(id_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_idx", block.alias("b")))),
                                 lambda x: x["b"]), "\n\n").alias("highlighted_schema"))
    fks = links.select(id_col, "db_id", F.concat_ws(".", "table", "column").alias("src")) \
               .join(broadcast_if_small(fk_map), ["db_id", "src"], "inner") \
               .groupBy(id_col).agg(F.sort_array(F.collect_list(
                   F.concat(F.lit("'"), F.col("src"), F.lit("': '"), F.col("tgt"), F.lit("'")))).alias("__e"))
    ids = links.select(id_col).distinct()
    return ids.join(text, id_col, "left").join(fks, id_col, "left").select(
        id_col, F.coalesce("highlighted_schema", F.lit("")).alias("highlighted_schema"),
        F.concat(F.lit("{"), F.coalesce(F.array_join("__e", ", "), F.lit("")), F.lit("}")).alias("foreign_keys"))
