"""Calls of a predictor are made once, whatever is lost on the way."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qcorpus.functions import scoring as S
from qcorpus.operators.attempts import generate_until_class
from qcorpus.operators.inference import _shard_answers, logged_generate


def counting(folder, die_after=None):
    """A predictor that notes each prompt, and once ends its process."""
    def factory():
        def predict(prompts):
            if die_after and len(os.listdir(folder)) >= die_after and not os.path.exists(folder + ".died"):
                open(folder + ".died", "w").close()
                os._exit(1)
            for p in prompts:
                n = len(os.listdir(folder))
                with open(os.path.join(folder, f"{os.getpid()}-{n}-{abs(hash(p))}"), "w") as f:
                    f.write(p)
            return [{"text": p.upper(), "prompt_tokens": len(p), "completion_tokens": 1} for p in prompts]
        return predict
    return factory


def calls_of(folder):
    return Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_a_killed_round_goes_on_where_it_stopped(spark, tmpdir_path):
    noted, log = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "log")
    os.mkdir(noted)
    df = spark.range(300).select("id", F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("prompt"))

    def run():
        return logged_generate(df, "prompt", counting(noted, die_after=40), log, "v1", batch_size=4, shards=6)
    with pytest.raises(Exception):
        run().collect()  # a local session does not retry tasks
    finished = {r["text"] for n in range(6) for r in _shard_answers(f"{log}/shard={n}").values()}
    assert 0 < len(finished) < 100
    rows = run().collect()
    assert sorted(r.id for r in rows) == list(range(300))
    assert all(r.output == r.prompt.upper() and r.prompt_tokens == len(r.prompt) and r.generation_error is None for r in rows)
    made = calls_of(noted)
    assert set(made) == {f"p{n}" for n in range(100)}
    assert all(made[t.lower()] == 1 for t in finished)
    before = sum(made.values())
    assert run().count() == 300 and sum(calls_of(noted).values()) == before  # all from the log
    other = logged_generate(df.limit(3), "prompt", counting(noted), log, "v2", shards=6)
    assert other.count() == 3 and sum(calls_of(noted).values()) > before  # another version asks anew


def test_failures_are_tried_again_and_damaged_lines_are_passed_over(spark, tmpdir_path):
    log, flag = os.path.join(tmpdir_path, "log"), os.path.join(tmpdir_path, "healthy")

    def factory():
        def predict(prompts):
            if "bad" in prompts and not os.path.exists(flag):
                raise ValueError("no")
            return [{"text": "<" + p + ">"} for p in prompts]
        return predict
    df = spark.createDataFrame([(1, "bad"), (2, "good"), (3, None), (4, ""), (5, "good")], "id int, q string")

    def run():
        return {r.id: (r.output, r.generation_error) for r in logged_generate(df, "q", factory, log, "v", shards=2).collect()}
    assert run() == {1: (None, "ValueError: no"), 2: ("<good>", None), 3: ("<>", None), 4: ("<>", None), 5: ("<good>", None)}
    for n in range(2):
        os.makedirs(f"{log}/shard={n}", exist_ok=True)
        with open(f"{log}/shard={n}/torn.jsonl", "w") as f:
            f.write('not json\n{"key": "abc", "text": "cut of')
    open(flag, "w").close()
    assert run()[1] == ("<bad>", None)
    assert logged_generate(df.limit(0), "q", factory, log, "v", shards=2).count() == 0


def test_rounds_of_the_retry_loop_come_from_the_log(spark, tmpdir_path):
    noted, log = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "log")
    os.mkdir(noted)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["simple", "complex", "simple"])], "item_id long, target string")

    def generate(pending, rnd):
        asked = pending.withColumn("round", F.lit(rnd)).withColumn("prompt", F.concat(F.lit("select a from t"), "item_id"))
        return logged_generate(asked, "prompt", counting(noted), log, "v", salt_col="round", shards=2) \
            .select("item_id", "target", F.col("output").alias("sql"))

    def run():
        out = generate_until_class(items, generate, S.score_columns, max_rounds=3)
        return sorted((r.item_id, r.outcome) for r in out.collect())
    first = run()
    made = calls_of(noted)
    assert sum(made.values()) == 3 + 1 + 1  # the item that is never accepted is asked in every round
    assert run() == first and calls_of(noted) == made
