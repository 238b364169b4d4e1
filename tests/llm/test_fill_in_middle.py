import hashlib
import random
import re

from qcorpus.llm import fill_in_middle as M
from qcorpus.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.fixtures import docs, no_docs


def brute(doc_id, text):
    """The rule word for word, by re.findall and slices of the list."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return [((r["doc_id"], r["text"]), (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["back"])
            for r in M.fill_in_middle(df).withColumn("back", M.restored()).collect()]


def held(rows):
    for (doc_id, text), got, back in rows:
        assert got == brute(doc_id, text), doc_id
        assert back == (text or "")


def test_hard_rows(spark):
    df = docs(spark).withColumnRenamed("score", "form").withColumnRenamed("row", "body").withColumnRenamed("lang", "cut")
    out = M.fill_in_middle(df)
    assert sorted(out.columns) == sorted([*df.columns, "n", "prefix_chars", "middle_chars", "output"])
    rows = rows_of(df)
    assert len(rows) == df.count()
    held(rows)


def test_odd_texts(spark):
    rng = random.Random(3)
    parts = ["<", "P", ">", "<P", "P>", "<S", "M>", "<P>", "ab", " ", "é", "🐋", "\n", "<M", "\x00", "x" * 50]
    texts = ["".join(rng.choice(parts[:7] + parts[8:]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts += ["".join(rng.choice(parts) for _ in range(8)) for _ in range(100)]
    rows = rows_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    held(rows)
    assert {got[1] for _, got, _ in rows} == {"plain", "psm", "spm"}


def test_slices_equal_one_match():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bcd" * 9, " ", "é", "Z", "."]) for _ in range(rng.randint(1, 60)))
        h1, h2 = rng.randrange(1 << 32), rng.randrange(1 << 32)
        for size in (1, 2, 7, 40):
            assert M.cuts(text, h1, h2, size) == M.cuts(text, h1, h2, 10 ** 6)


def test_long_texts(spark):
    texts = [(1, "ab, " * 700_000), (2, "x" * 2_000_000), (3, "." * 900_000 + "end")]
    held(rows_of(spark.createDataFrame(texts, "doc_id long, text string")))


def test_empty_table(spark):
    assert M.fill_in_middle(no_docs(spark)).collect() == []


def test_query_equals_the_rule_on_whole_documents(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        *rest, output = brute(r["doc_id"], r["text"])
        want.append((r["doc_id"], *rest, sha(output), sha(r["text"] or "")))
    got = [tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, SF_SMALL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
