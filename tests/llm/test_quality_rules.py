import math
import re
from collections import Counter

from qcorpus.llm import quality_rules as Q
from tests.conftest import SF_SMALL
from tests.llm.fixtures import docs, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {p for i, x in enumerate(windows) if count[x] > 1 for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def histograms(text):
    t = text or ""
    sets = [lambda c: "a" <= c <= "z", lambda c: c in " \t\n\v\f\r", lambda c: ord(c) > 127, lambda c: "A" <= c <= "Z",
            lambda c: "0" <= c <= "9", lambda c: c in "#*$%&|<>", lambda c: c in ".,;:!?'\"()-"]
    classes = [sum(map(s, t)) for s in sets]
    classes.append(len(t) - sum(classes))
    words = Counter(w.lower() for w in WORD.findall(t) if w.lower() in Q.vocabulary() and w in (w.lower(), w.capitalize(), w.upper() if len(w) == 1 else w.lower()))
    common = [words[w] for w in Q.vocabulary()]
    return classes, common + [len(WORD.findall(t)) - sum(common)]


def distance(counts, reference):
    n, m = sum(counts), sum(reference)
    if not n:
        return 0.0
    total = 0.0
    for x, y in zip(counts, reference):
        p, q = x / n, y / m
        for v in (p, q):
            if v:
                total += v * math.log2(v / ((p + q) / 2)) / 2
    return math.sqrt(max(total, 0))


def brute(rows):
    """(counts, class distance, word distance) per (text, lang) row."""
    data = [(lang, base(t), *histograms(t)) for t, lang in rows]

    def references(keep):
        sums = {}
        for k, (lang, b, c, w) in enumerate(data):
            if lang in Q.COMMON_WORDS and not b[5] and keep(k):
                old = sums.get(lang, ([0] * len(c), [0] * len(w)))
                sums[lang] = ([x + y for x, y in zip(old[0], c)], [x + y for x, y in zip(old[1], w)])
        return sums

    def measured(sums):
        return [tuple(min((distance(h, r[j]) for r in sums.values()), default=0.0) for j, h in ((0, c), (1, w)))
                for _, _, c, w in data]
    sums = references(lambda k: True)
    for limit in Q.TRIM:
        far = measured(sums)
        sums = references(lambda k: far[k][0] <= limit) or sums
    return [(b, *d) for (_, b, _, _), d in zip(data, measured(sums))]


def check(df):
    rows = df.collect()
    key = lambda r: (str(r["doc_id"]), str(r["n_words"]), r["base_failed"])
    got = sorted(Q.quality_rules(df, ["doc_id", "lang"]).collect(), key=key)
    want = {}
    for r, b in zip(rows, brute([(r["text"], r["lang"]) for r in rows])):
        want.setdefault((str(r["doc_id"]), b[0][0]), []).append((b, r["lang"]))
    for r in got:
        (b, c, w), _ = want[str(r["doc_id"]), r["n_words"]][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == b
        assert abs(r["class_distance"] - c) < 1e-9 and abs(r["word_distance"] - w) < 1e-9
        assert not (r["base_failed"] and r["kept"])
    assert len(got) == len(rows)


def test_equals_brute_force(spark):
    check(docs(spark))


def test_equals_brute_force_on_the_given_table(spark):
    check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))


def test_all_columns_pass_and_clashing_ones_are_replaced(spark):
    df = docs(spark).withColumnRenamed("score", "kept")
    out = Q.quality_rules(df)
    assert [c for c in out.columns if c in df.columns and c != "kept"] == [c for c in df.columns if c != "kept"]
    slim = sorted(map(str, Q.quality_rules(df, ["doc_id"]).select("doc_id", "n_words", "kept").collect()))
    assert sorted(map(str, out.select("doc_id", "n_words", "kept").collect())) == slim


def test_junk_goes_and_prose_stays(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = Q.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["doc_id"]).join(labels, "doc_id")
    share = {r["quality"]: r["k"] for r in out.where("n_words >= 20").groupBy("quality")
             .agg({"kept": "max"}).selectExpr("quality", "0.0 as k").collect()}
    for quality in share:
        x = out.where(f"quality = {quality} and n_words >= 20")
        share[quality] = x.where("kept").count() / x.count()
    assert share[1] > 0.99 and share[0] < 0.2


def test_languages_without_a_reference_stay(spark):
    """Clean Cyrillic and Greek texts beside the given ones; without a named
    language they are held against the references there are."""
    import random
    rng = random.Random(4)
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = []
    for k, letters in enumerate(["абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρσ"] * 5):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)]
        rows += [(-1 - k, " ".join(words).capitalize() + ".", ["ru", "el"][k % 2]), (-101 - k, " ".join(words), None)]
    both = table.unionByName(spark.createDataFrame(rows, table.schema))
    out = {r["doc_id"]: r["kept"] for r in Q.quality_rules(both, ["doc_id"]).where("doc_id < 0").collect()}
    assert all(out[d] for d in out if d > -100) and not any(out[d] for d in out if d < -100)


def test_empty_table(spark):
    assert Q.quality_rules(no_docs(spark)).collect() == []


def test_drop_rejected_keeps_what_the_rules_keep(spark):
    """Rows, copies and clashing column names as given; null langs and texts too."""
    clean = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"], r["lang"], r["doc_id"]) for r in clean.collect()]
    rows += rows[:3] + [(900, None, "en", 0), (901, "", None, 0), (902, "few words", "en", 0), (903, rows[0][1], None, 0),
                        (None, rows[1][1], "xx", 0), (904, "spam word " * 60, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, key1 long")
    key = lambda r: str(tuple(r))
    want = Q.quality_rules(df).where("kept").select(*df.columns).collect()
    got = Q.drop_rejected(df)
    assert got.columns == df.columns and sorted(map(key, got.collect())) == sorted(map(key, want)) and 0 < len(want) < len(rows)
    assert Q.drop_rejected(df.limit(0)).collect() == []


def test_totals_are_stored(spark):
    """Distances read a histogram's stored sum (finding 1: it was added up again for every bin)."""
    kept = Q.drop_rejected(docs(spark).select("doc_id", "text", "lang"))
    assert "n_common" in (plan := kept._jdf.queryExecution().optimizedPlan().toString())
    assert "aggregate(common" not in plan and "aggregate(classes" not in plan
