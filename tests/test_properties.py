"""Property tests (hypothesis): each example is evaluated by Spark in one
batch, against a plain-Python statement of the property."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from qcorpus.functions import text as T
from qcorpus.operators import evaluate as EV
from qcorpus.operators import ranking as R
from qcorpus.operators import walks as W

WORDS = st.sampled_from(["select", "a", "b", "count", "students", "running", "x1", "(", ")", "`t`", "  "])
TEXTS = st.lists(WORDS, min_size=0, max_size=12).map(" ".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=30))
def test_em_symmetric_and_rouge_swap(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, g string")
    rows = df.select(T.exact_match("p", "g").alias("e1"), T.exact_match("g", "p").alias("e2"),
                     EV.rouge_l("p", "g").alias("r1"), EV.rouge_l("g", "p").alias("r2"),
                     EV.rouge_l("p", "p").alias("same"), "p").collect()
    for r in rows:
        assert r.e1 == r.e2
        assert abs(r.r1.p - r.r2.r) < 1e-12 and abs(r.r1.r - r.r2.p) < 1e-12
        if EV.rouge_tokens(r.p):
            assert r.same.f1 == 1.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10_000)), min_size=1, max_size=200, unique_by=lambda t: t[1]),
       st.integers(1, 50))
def test_bucketed_row_number_is_a_window(spark, rows, width):
    df = spark.createDataFrame(rows, "g int, k int")
    mine = R.bucketed_row_number(df, ["g"], "k", "rn", bucket_width=width).select("g", "k", "rn")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("bigint"))
    assert mine.exceptAll(ref).count() == 0 and ref.exceptAll(mine).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=5), min_size=1, max_size=20))
def test_pack_budget_equals_loop(spark, walks_lengths):
    walks, descs = [], []
    for i, lens in enumerate(walks_lengths):
        names = [f"t{i}_{j}" for j in range(len(lens))]
        walks.append((i, "d", names))
        descs += [("d", n, "x" * ln) for n, ln in zip(names, lens)]
    wdf = spark.createDataFrame(walks, "walk_id int, db_id string, path array<string>")
    ddf = spark.createDataFrame(descs, "db_id string, table_name string, schema_str string")
    got = {r.walk_id: (r.kept_tables, r.context) for r in W.pack_budget(wdf, ddf).collect()}
    for i, lens in enumerate(walks_lengths):
        kept, total = [], 0
        for ln in lens:          # the reference's loop
            if total + ln + 500 > 8000:
                break
            kept.append("x" * ln)
            total += ln + 2
        exp = (len(kept), "\n\n".join(kept)[:8000]) if kept else None
        assert got.get(i) == exp
