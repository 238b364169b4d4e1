"""Hand values (FIXTURES §3) and an independent plain-Python model of the
keyword score on many generated statements."""

import random
import re

from pyspark.sql import functions as F

from qcorpus.functions import scoring as S


def _py_score(sql):
    """Independent model written from the rule text."""
    if not sql or not sql.strip():
        return (0, 0, 0, 0.0, None)
    s = sql.upper()
    for p in (r"`[^`]*`", r"'[^']*'", r'"[^"]*"'):
        s = re.sub(p, "", s)
    f = []
    for b in (S.BUCKET_B1, S.BUCKET_B3, S.BUCKET_B4):
        f.append(sum(len(re.findall(r"\b" + re.escape(k) + r"\b", s)) for k in b))
    tot = sum(f)
    r = sum(x * (x / tot) for x in f) if tot else 0.0
    b1, b3, b4 = (x > 0 for x in f)
    cls = ("complex" if b1 and b3 and b4 else "aggregation" if b1 and b4 else
           "conditional" if b1 and b3 else "simple" if b1 else None)
    return (f[0], f[1], f[2], r, cls)


def _score(spark, sqls):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sqls)], "i int, sql string")
    out = S.score_columns(df).orderBy("i").collect()
    return [(r.b1, r.b3, r.b4, r.reward, r.difficulty) for r in out]


def test_clean_sql_hand_value(spark):
    df = spark.createDataFrame([("select `a` from t where x='in' and y=\"or\"",)], "s string")
    assert df.select(S.clean_sql("s")).first()[0] == "SELECT  FROM T WHERE X= AND Y="


def test_keyword_edge_cases(spark):
    got = _score(spark, ["SELECT a FROM t GROUP  BY a", "SELECT a FROM t ORDER BY a",
                         "SELECT a FROM t WHERE x ÉIN y", "   ", None,
                         "SELECT a FROM t INNER JOIN u ON a = b"])
    assert got[0][0] == 2          # GROUP  BY (two spaces) is not a hit
    assert got[1][1] == 0          # ORDER does not hit OR
    assert got[2][1] == 0          # no IN inside ÉIN (Unicode word boundary)
    assert got[3] == (0, 0, 0, 0.0, None) and got[4] == (0, 0, 0, 0.0, None)
    assert got[5][0] == 5  # SELECT, FROM, JOIN, INNER JOIN, ON: INNER JOIN also counts as JOIN (Q4)


def test_desc_only_is_aggregation(spark):
    assert _score(spark, ["SELECT a FROM t ORDER BY a DESC"])[0][4] == "aggregation"  # quirk Q1


def test_generated_statements_match_python_model(spark):
    rnd = random.Random(7)
    words = ["SELECT", "FROM", "WHERE", "JOIN", "INNER JOIN", "LEFT JOIN", "GROUP BY", "ORDER BY", "IN", "AND",
             "OR", "NOT", "CASE", "WHEN", "THEN", "ELSE", "END", "COUNT(*)", "AVG(x)", "DESC", "ASC", "x", "t",
             "'in'", '"or"', "`between`", "=", ",", "(", ")", "select", "GROUP  BY", "ORDERS", "INTO", "ON"]
    sqls = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    got = _score(spark, sqls)
    for s, g in zip(sqls, got):
        exp = _py_score(s)
        assert g[:3] == exp[:3] and abs(g[3] - exp[3]) < 1e-9 and g[4] == exp[4], (s, g, exp)
        if sum(g[:3]) > 0:  # reward is a frequency-weighted mean of the bucket counts
            assert sum(g[:3]) / 3 - 1e-9 <= g[3] <= max(g[:3]) + 1e-9


def test_clean_sql_idempotent(spark):
    rnd = random.Random(3)
    alphabet = "ab'\"` SELECT in"
    xs = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "s string").select(S.clean_sql("s").alias("c"))
    rows = df.select("c", S.clean_sql("c").alias("cc")).collect()
    assert all(r.c == r.cc for r in rows)


def test_forbidden_and_missing(spark):
    df = spark.createDataFrame([("SELECT a, COUNT(*) FROM t GROUP BY a", "simple"),
                                ("SELECT a FROM t", "complex")], "sql string, target string")
    df = S.score_columns(df)
    r = df.select(S.forbidden_words("sql", "target").alias("f"),
                  S.forbidden_words("sql", "target", strict_compat=True).alias("fc"),
                  S.missing_buckets(F.col("buckets_present"), F.col("target")).alias("m")).collect()
    assert r[0].f == ["COUNT", "GROUP BY"] and r[0].fc == ["COUNT"]
    assert r[1].m == ["B3", "B4"]


def test_reward_struct_equals_columns(spark):
    from qcorpus.plans import fixtures
    from tests.conftest import SF_SMALL
    c = fixtures.load(spark, SF_SMALL, "sql_corpus")
    a = S.score_columns(c).select("question_id", "b1", "b3", "b4", "total_hits", "difficulty",
                                  F.round("reward", 9).alias("reward"))
    r = c.select("question_id", S.reward_struct("sql").alias("r"))
    b = r.select("question_id", F.col("r.bucket_freq")["B1"].alias("b1"), F.col("r.bucket_freq")["B3"].alias("b3"),
                 F.col("r.bucket_freq")["B4"].alias("b4"), F.col("r.total_hits").alias("total_hits"),
                 F.col("r.difficulty").alias("difficulty"), F.round("r.reward", 9).alias("reward"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    one = spark.createDataFrame([("SELECT a FROM t INNER JOIN u ON a = b",)], "s string") \
        .select(S.reward_struct("s").alias("r")).first().r
    # the one JOIN word counts for JOIN and for INNER JOIN (quirk Q4)
    assert dict(one.bucket_hits["B1"]) == {"SELECT": 1, "FROM": 1, "JOIN": 1, "ON": 1, "INNER JOIN": 1}


def test_bucket_shares_sum_to_one(spark):
    from qcorpus.plans import fixtures
    from tests.conftest import SF_SMALL
    r = fixtures.load(spark, SF_SMALL, "sql_corpus").select(S.reward_struct("sql").alias("r"))
    rows = r.select(F.col("r.total_hits").alias("t"),
                    F.aggregate(F.map_values("r.bucket_score"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(x.s - 1.0) < 1e-12 if x.t > 0 else x.s == 0.0 for x in rows)


def test_fixture_table_per_template(spark):
    """FIXTURES.md: expected (B1, B3, B4, reward, class) per question_id % 8."""
    from qcorpus.plans import fixtures
    from tests.conftest import SF_SMALL
    expected = {0: (3, 0, 0, 3.0, "simple"), 1: (3, 1, 0, 2.5, "conditional"), 2: (3, 0, 1, 2.5, "aggregation"),
                3: (8, 2, 2, 6.0, "complex"), 4: (4, 0, 1, 3.4, "aggregation"), 5: (3, 0, 0, 3.0, "simple"),
                6: (0, 0, 0, 0.0, None), 7: (0, 0, 0, 0.0, None)}
    df = S.score_columns(fixtures.load(spark, SF_SMALL, "sql_corpus"))
    got = df.select((F.col("question_id") % 8).alias("k"), "b1", "b3", "b4", F.round("reward", 9).alias("r"),
                    "difficulty").distinct().collect()
    assert {r.k: (r.b1, r.b3, r.b4, r.r, r.difficulty) for r in got} == expected
    assert len(got) == 8  # one outcome per template
