"""The automaton against substring tests name by name."""

import random

import pytest

from qcorpus.operators import linking as L

COLUMNS = [("a", t, c) for t, cs in {"orders": ["o_id", "id", "total price", "o"], "order": ["id", "day"], "line": ["id", "Line"],
                                     "": ["day"], "x.y": ["a+b", "("]}.items() for c in cs]
COLUMNS += [("b", "tab", "col"), ("b", "tab", "col"), ("b", None, "col"), ("c", "tab", None)]


def data(spark, rng, n=300):
    parts = ["orders", "order", "o_id", "id", " ", ",", "*", "total price", "Line", "line", "x.y", "a+b", "(", "day", "_", "tab", "col", "é"]
    rows = [(k, rng.choice(["a", "a", "b", "c", "zz", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))))
            for k in range(n)] + [(n, "a", None)]
    return rows, spark.createDataFrame(rows, "question_id long, db_id string, sql string").repartition(3)


def wanted(rows, star, inside):
    out = set()
    for k, db, text in rows:
        for d, t, c in COLUMNS:
            if text is None or d != db or t is None or c is None or not inside(t, text):
                continue
            if inside(c, text):
                out.add((k, t, c))
            if star and "*" in text:
                out.add((k, t, "*"))
    return out


def word(name, text):
    if not name:
        return True
    at = text.find(name)
    while at >= 0:
        around = text[max(at - 1, 0):at] + text[at + len(name):at + len(name) + 1]
        if not any(c == "_" or (c.isascii() and c.isalnum()) for c in around):
            return True
        at = text.find(name, at + 1)
    return False


@pytest.mark.parametrize("star,whole_word", [(False, False), (True, False), (False, True)])
def test_links_equal_single_tests(spark, star, whole_word):
    rows, texts = data(spark, random.Random(star + 2 * whole_word))
    columns = spark.createDataFrame(COLUMNS, "db_id string, table_name string, column_name string")
    got = [tuple(r) for r in L.link_schema(texts, columns, star=star, whole_word=whole_word).collect()]
    assert len(got) == len(set(got))
    assert set(got) == wanted(rows, star, word if whole_word else lambda n, t: n in t)


def test_without_the_library(spark, monkeypatch):
    monkeypatch.setattr(L, "_automaton", lambda words: None)
    finder = L.NameFinder('[{"table_name": "aa", "column_name": "a"}, {"table_name": "aa", "column_name": "b.c"}]')
    assert finder.links("xaaa b.c", False, False) == [("aa", "a"), ("aa", "b.c")] and finder.links("b_c aa", False, True) == []


def test_cover_and_carried_columns(spark):
    columns = spark.createDataFrame(COLUMNS, "db_id string, table_name string, column_name string")
    texts = spark.createDataFrame([(1, "b", "tab col", "col tab"), (2, "b", "tab col", "tab"), (3, "b", "none", None), (4, None, "tab", "x")],
                                  "question_id long, db_id string, sql string, cand string")
    assert {tuple(r) for r in L.covers_schema(texts, columns, "sql", "cand").collect()} == {(1, True), (2, False), (3, True), (4, True)}
    linked = L.link_schema(texts, columns, carry=("db_id", "cand"))
    assert linked.columns == ["question_id", "db_id", "cand", "table", "column"] and linked.count() == 2


def test_empty_tables(spark):
    columns = spark.createDataFrame([], "db_id string, table_name string, column_name string")
    texts = spark.createDataFrame([(1, "b", "tab")], "question_id long, db_id string, sql string")
    assert L.link_schema(texts, columns).collect() == [] and L.link_schema(texts.limit(0), columns).collect() == []


def test_names_are_pairs_without_field_names():
    f = L.NameFinder('[["orders", "o_id"], ["orders", null], [null, "id"], ["line", "id"]]')
    assert f.columns == {"orders": ["o_id"], "line": ["id"]}
    assert f.links("select o_id, id from orders", False, False) == [("orders", "o_id")]


def test_more_rows_than_are_read_at_a_time(spark):
    n = 2 * L.FOUND_ROWS + 7
    texts = spark.range(n, numPartitions=1).selectExpr("id as question_id", "case id % 3 when 0 then 'a' when 1 then 'b' end as db_id",
                                                       "concat('tab col orders o_id ', id) as sql")
    columns = spark.createDataFrame(COLUMNS, "db_id string, table_name string, column_name string")
    got = {r.question_id: {tuple(x) for x in r.links} for r in L.with_links(texts, columns, whole_word=True).collect()}
    assert len(got) == n
    assert all(("orders", "o_id") in got[k] for k in range(0, n, 3))
    assert all(got[k] == {("tab", "col")} for k in range(1, n, 3)) and all(not got[k] for k in range(2, n, 3))
