"""Each stage of the pipeline against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline
from qcorpus.llm.scratch import stored
from tests.conftest import SF_SMALL
from tests.llm import test_ngram_jaccard, test_quality_rules, test_sentence_spans
from tests.llm.fixtures import docs, no_docs


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def walk(spark, df):
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, df, SF_SMALL), "stage")
        out.append((df, after))
        df = after
    return out


def test_stages(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    quality, near, spans, mix, encoded = walk(spark, table)
    for before, after in (quality, near, spans, mix):
        assert after.columns == table.columns and after.dtypes == table.dtypes and after.count()
    base = {r["doc_id"]: test_quality_rules.base(r["text"])[5] for r in quality[0].collect()}
    kept = {r["doc_id"] for r in quality[1].collect()}
    assert not any(base[d] for d in kept) and len(kept) > 0.7 * sum(not b for b in base.values())
    want = Counter(d for d, _, c in test_ngram_jaccard.brute(rows_of(near[0])) if d == c)
    assert Counter(d for d, _ in rows_of(near[1])) == want
    before = sorted(rows_of(spans[0]), key=str)
    left = {d: " ".join(w) for (d, _), w in zip(before, test_sentence_spans.brute(before, test_sentence_spans.content_cut, 1)) if w}
    assert {d: " ".join(t.split()) for d, t in rows_of(spans[1])} == left
    texts = dict(rows_of(mix[0]))
    count = Counter(d for d, _ in rows_of(mix[1]))
    assert max(count.values()) <= 2 and all(t in texts[d] or t == " ".join(t.split()) for d, t in rows_of(mix[1]))
    words = [sum(len((t or "").split()) for _, t in rows_of(x)) for x in mix]
    assert abs(words[1] - 1.5 * words[0]) <= 20
    assert all(r["roundtrip"] and r["parity"] for r in encoded[1].collect())
    assert [c for c in encoded[1].columns if c in table.columns] == table.columns


def test_hard_rows_and_empty_table(spark):
    for df in (docs(spark), no_docs(spark)):
        *_, (_, after) = walk(spark, df.select("doc_id", "text", "lang", "source", "n_chars"))
        assert "token_ids" in after.columns


def test_run(spark):
    *_, (_, after) = walk(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    key = lambda r: str((r["doc_id"], r["token_ids"]))
    assert sorted(map(key, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(key, after.collect()))


def test_passages_in_the_middle_of_sentences_go(spark):
    """200 words that two documents share, set anywhere in a sentence."""
    import random
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    rows = []
    for k in range(20):
        passage = [word() for _ in range(200)]
        for d in (2 * k, 2 * k + 1):
            rows.append((d, " ".join([word() for _ in range(rng.randint(3, 40))] + passage + [word() for _ in range(30)])))
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: len(r["text"].split()) for r in corpus_pipeline.repeated_passages(spark, df, SF_SMALL).collect()}
    before = {d: len(t.split()) for d, t in rows}
    assert all(out[d] == before[d] for d in range(0, 40, 2)) and all(out[d] <= before[d] - 168 for d in range(1, 40, 2))


def test_stages_run_by_others_get_small_batches(spark):
    """A stage's last step runs after the stage returned (finding 1: with batches of 64 MB)."""
    from qcorpus.llm import scratch
    name = scratch._BATCH_SETTING
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for stage in (corpus_pipeline.repeated_passages, corpus_pipeline.encode):
        spark.conf.unset(name)
        try:
            stage(spark, table, SF_SMALL)
            assert spark.conf.get(name) == str(scratch.BATCH_BYTES)
            spark.conf.set(name, "1234567")
            stage(spark, table, SF_SMALL)
            assert spark.conf.get(name) == "1234567"
        finally:
            spark.conf.unset(name)
