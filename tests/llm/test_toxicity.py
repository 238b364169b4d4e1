import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from qcorpus.llm import kernel
from qcorpus.llm import toxicity as X
from tests.llm.fixtures import docs, no_docs

BAD = ["vile", "awful", "rotten"]
PLAIN = [f"w{i}" for i in range(300)]


def made(n, seed=0, clean_bad=False):
    """(doc_id, text, toxic, offending sentences)."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        sentences = [[rng.choice(PLAIN) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 9))]
        toxic, hit = rng.random() < 0.3, []
        if toxic:
            hit = sorted(rng.sample(range(len(sentences)), rng.randint(1, min(2, len(sentences)))))
            for h in hit:
                sentences[h].insert(rng.randint(0, 3), rng.choice(BAD))
        rows.append((k, " ".join(" ".join(s).capitalize() + "." for s in sentences), int(toxic), hit))
    return rows


def data(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_places(spark):
    rows = made(900)
    docs, labels = data(spark, rows)
    out = X.score(docs, X.train(docs, labels)).withColumn("held_out", X.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held_out"]]
    assert 200 < len(held) < 400
    truth = {r[0]: r for r in rows}
    right = sum(r["predicted"] == truth[r["doc_id"]][2] for r in held)
    assert right / len(held) > 0.97
    found = missed = wrong = 0
    for r in held:
        text, hits = truth[r["doc_id"]][1], truth[r["doc_id"]][3]
        sentences = [s.strip() for s in text.split(".") if s.strip()]
        named = {text[o["begin"]:o["end"]] for o in r["offending"]}
        found += sum(sentences[h] in named for h in hits)
        missed += sum(sentences[h] not in named for h in hits)
        wrong += len(named - {sentences[h] for h in hits})
    assert found > 0.9 * (found + missed) and wrong < 0.1 * found + 3


def test_held_out_labels_do_not_matter(spark):
    docs, labels = data(spark, made(300))
    a = X.train(docs, labels)
    flipped = labels.selectExpr("doc_id", "quality",
                                "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    b = X.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_noisy_or_by_hand(spark):
    _, _, _, words = kernel.words(np.frombuffer(b"one two three four five", np.uint8), np.array([0, 23]))
    model = X.NoisyOr(np.sort(words), np.full(5, 0.25), -1.0)
    df = spark.createDataFrame([(1, "One two three. Four!\nfive"), (2, ""), (3, None), (4, " .!? ")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in X.score(df, model).collect()}
    p = [1 / (1 + np.exp(-(0.25 * n - 1))) for n in (3, 1, 1)]
    assert abs(out[1]["score"] - (1 - np.prod(1 - np.array(p)))) < 1e-6 and out[1]["n_sentences"] == 3
    assert all(out[k]["score"] == 0 and out[k]["predicted"] == 0 and out[k]["offending"] == [] for k in (2, 3, 4))


def test_hard_rows(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(None, 1, 1), (10, None, None), (11, 1, 1), (11, 1, 1), (12, 1, 0), (99999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = X.score(df, X.train(df, labels))
    assert out.columns == [c for c in df.columns if c != "score"] + ["score", "predicted", "n_sentences", "offending"]
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = no_docs(spark)
    assert X.score(df, X.train(df, none)).collect() == []
    assert {r["predicted"] for r in X.score(docs(spark), X.train(docs(spark), none)).collect()} == {0}


def trained_by_hand(rows):
    """(features, weights, bias) of the training rule in plain loops; only the
    hashes of a single word come from the library."""
    def features_of(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return [int(f) for f in X._sentences(raw, np.array([0, len(raw)]))[0].ravel() if f]
    bags = []
    for doc_id, text, toxic, _ in rows:
        if zlib.crc32(str(doc_id).encode()) % 3 != 1 and text:
            sentences = [re.findall(r"[A-Za-z0-9]+", s) for s in re.split(r"[.!?\n]", text)]
            bags.append((toxic, [[f for w in s for f in features_of(w)] for s in sentences if s]))
    n = [sum(1 - y for y, _ in bags), sum(y for y, _ in bags)]
    seen = {}
    for y, bag in bags:
        for f in {f for s in bag for f in s}:
            seen.setdefault(f, [0, 0])[y] += 1
    chosen = []
    for f, have in seen.items():
        table = [(have[y], n[y], sum(have)) for y in (0, 1)] + [(n[y] - have[y], n[y], sum(n) - sum(have)) for y in (0, 1)]
        g = sum(2 * a * math.log(a * sum(n) / (b * c)) for a, b, c in table if a)
        if sum(have) >= 3 and g >= X.MIN_STATISTIC:
            chosen.append(f)
    chosen.sort()
    place = {f: k for k, f in enumerate(chosen)}
    bags = [(y, [[place[f] for f in s if f in place] for s in bag]) for y, bag in bags]
    share = n[1] / sum(n)
    values = [0.0] * len(chosen) + [-5.0]
    moment, speed = [0.0] * len(values), [0.0] * len(values)
    for step in range(1, 251):
        grad = [1e-4 * v for v in values[:-1]] + [0.0]
        for y, bag in bags:
            p = [1 / (1 + math.exp(-max(-30, min(30, sum(values[k] for k in s) + values[-1])))) for s in bag]
            clean = math.prod(1 - q for q in p)
            pull = -clean / (1 - clean) * 0.3 / share if y else 0.7 / (1 - share)
            for q, s in zip(p, bag):
                for k in [*s, -1]:
                    grad[k] += q * pull / len(bags)
        for k, d in enumerate(grad):
            moment[k] = 0.9 * moment[k] + 0.1 * d
            speed[k] = 0.999 * speed[k] + 0.001 * d * d
            values[k] -= 0.15 * (moment[k] / (1 - 0.9 ** step)) / (math.sqrt(speed[k] / (1 - 0.999 ** step)) + 1e-8)
    return chosen, values[:-1], values[-1]


def test_training_equals_brute_force(spark):
    rows = made(150, seed=3) + [(1000, "", 1, []), (1001, "?!", 0, [])]
    model = X.train(*data(spark, rows))
    features, weights, bias = trained_by_hand(rows)
    assert [int(f) for f in model.features] == features and len(features) >= len(BAD)
    assert np.allclose(model.weights, weights, rtol=1e-4, atol=1e-5) and abs(model.bias - bias) < 1e-4
