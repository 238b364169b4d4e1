"""Batch inference with a model supplied by the user.

No model ships with the library.  A *factory* returns a predictor; it is
called once per task (inside ``mapInArrow``), so heavy models load once per
executor task and then see Arrow batches.  A predictor is a callable
``predict(prompts: list[str]) -> list[dict]`` whose dicts carry ``text`` and,
optionally, ``prompt_tokens`` / ``completion_tokens``.  A failed call yields
a null output for its rows, as the reference does on errors and timeouts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qcorpus.functions.status import apply_judgment
from qcorpus.functions.text import extract_fenced, parse_json_object, split_reasoning
from qcorpus.sources.json_array import open_store


COUNTS = ("prompt_tokens", "completion_tokens")


def batch_generate(df: DataFrame, prompt_col: str, factory: Callable, out_col: str = "output",
                   batch_size: int = 16, timeout_sec: float | None = None) -> DataFrame:
    """``df`` plus ``out_col`` (text), token counts and
    ``generation_error`` per row.

    A call that raises is repeated prompt by prompt, so one bad prompt costs
    only its own row.  A call that runs longer than ``timeout_sec`` is given up
    (its rows get the error ``timeout``) and a new predictor on a new thread
    takes the next calls, which do not queue behind the hung one."""
    fields = [f for f in df.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += f", `{out_col}` string, prompt_tokens bigint, completion_tokens bigint, generation_error string"
    at = df.columns.index(prompt_col)
    names = [*df.columns, out_col, *COUNTS, "generation_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows go on call by call: beside the Arrow batch a task holds one call's texts
        call = _caller(factory, timeout_sec)
        for batch in batches:
            for i in range(0, batch.num_rows, batch_size):
                part = batch.slice(i, batch_size)
                answers = call(["" if p is None else p for p in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *_answer_columns(answers)], names=names)

    return df.mapInArrow(run, schema)


def _answer_columns(answers: list[dict]) -> list[pa.Array]:
    counts = [pa.array(pd.array([r.get(c) for r in answers], dtype="Int64"), pa.int64()) for c in COUNTS]
    return [pa.array([r.get("text") for r in answers], pa.string()), *counts,
            pa.array([r.get("error") for r in answers], pa.string())]


def _caller(factory: Callable, timeout_sec: float | None) -> Callable[[list[str]], list[dict]]:
    """One answer per prompt, with ``error`` where the predictor failed."""
    import threading
    predict = factory()

    def once(chunk):
        nonlocal predict
        if not timeout_sec:
            return predict(chunk)
        got, own = {}, predict

        def work():
            try:
                got["result"] = own(chunk)
            except Exception as e:  # reported below, on the task's thread
                got["error"] = e
        worker = threading.Thread(target=work, daemon=True)
        worker.start()
        worker.join(timeout_sec)
        if worker.is_alive():
            predict = factory()
            raise TimeoutError("timeout")
        if "error" in got:
            raise got["error"]
        return got["result"]

    def call(chunk):
        try:
            return [dict(r or {}) for r in once(chunk)]
        except TimeoutError:
            return [{"error": "timeout"}] * len(chunk)
        except Exception as e:
            if len(chunk) == 1:
                return [{"error": f"{type(e).__name__}: {e}"}]
            return [r for prompt in chunk for r in call([prompt])]
    return call


def _with_answers(pdf: pd.DataFrame, answers: list[dict], out_col: str) -> pd.DataFrame:
    out = pdf.copy()
    out[out_col] = [r.get("text") for r in answers]
    out["prompt_tokens"] = pd.array([r.get("prompt_tokens") for r in answers], dtype="Int64")
    out["completion_tokens"] = pd.array([r.get("completion_tokens") for r in answers], dtype="Int64")
    out["generation_error"] = [r.get("error") for r in answers]
    return out


ANSWER_FIELDS = ("text", "prompt_tokens", "completion_tokens")


def _shard_answers(folder: str) -> dict[str, dict]:
    """Finished calls of a shard; a line that a lost executor left unfinished is
    passed over."""
    store, path = open_store(folder)
    out: dict[str, dict] = {}
    for file in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if not file.is_file or not file.path.endswith(".jsonl"):
            continue
        with store.open_input_stream(file.path) as f:
            for line in f.read().split(b"\n")[:-1]:
                try:
                    record = json.loads(line)
                except ValueError:
                    continue
                out[record["key"]] = record
    return out


def logged_generate(df: DataFrame, prompt_col: str, factory: Callable, log: str, version: str, out_col: str = "output",
                    batch_size: int = 16, timeout_sec: float | None = None, salt_col: str | None = None,
                    shards: int = 256) -> DataFrame:
    """:func:`batch_generate` with a log of finished calls in the shared
    folder ``log``, so that retried tasks, lost executors and reruns repeat
    none.

    A call is named by a hash of predictor ``version``, ``salt_col`` (e.g. the
    round, where the same prompt is to be asked anew) and prompt; it is made once
    however many rows carry it.  Calls are dealt to ``shards`` folders by that
    hash.  A task reads a shard's finished calls before its first, and writes a file
    of its own after every batch of ``batch_size`` calls, so at most the batch in
    flight is lost.  A task holds one shard of the log: choose ``shards`` so that
    this fits, and keep it for the life of the log.  Failed calls are not
    logged and are tried again by the next run.  A null prompt is asked as the
    empty text.  The columns added are those of ``batch_generate``."""
    parts = [F.lit(version), F.coalesce(F.col(salt_col).cast("string"), F.lit("")) if salt_col else F.lit(""),
             F.coalesce(F.col(prompt_col), F.lit(""))]
    keyed = df.withColumn("__call", F.sha2(F.to_json(F.array(*parts)), 256))
    calls = keyed.groupBy(F.col("__call").alias("key")).agg(F.first(F.coalesce(F.col(prompt_col), F.lit(""))).alias("prompt"))
    calls = calls.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")) \
                 .repartition(shards, "shard").sortWithinPartitions("shard", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, shard, known = None, None, {}
        for pdf in batches:
            for at, part in pdf.groupby("shard"):
                folder = f"{log.rstrip('/')}/shard={at}"
                if at != shard:
                    shard, known = at, _shard_answers(folder)
                todo = part[~part["key"].isin(known.keys())]
                for i in range(0, len(todo), batch_size):
                    chunk = todo.iloc[i:i + batch_size]
                    call = call or _caller(factory, timeout_sec)
                    answers = dict(zip(chunk["key"], call(chunk["prompt"].tolist())))
                    lines = [json.dumps({"key": k} | {f: a.get(f) for f in ANSWER_FIELDS}) + "\n"
                             for k, a in answers.items() if not a.get("error")]
                    if lines:
                        store, path = open_store(folder)
                        store.create_dir(path, recursive=True)
                        with store.open_output_stream(f"{path}/{uuid.uuid4().hex}.jsonl") as f:
                            f.write("".join(lines).encode())
                    known.update(answers)
                yield _with_answers(part[["key"]], [known[k] for k in part["key"]], "answer")

    answers = calls.mapInPandas(run, "key string, answer string, prompt_tokens bigint, completion_tokens bigint, "
                                     "generation_error string")
    new = ["prompt_tokens", "completion_tokens", "generation_error"]
    answers = answers.select(F.col("key").alias("__call"), F.col("answer").alias(out_col), *new)
    return keyed.join(answers, "__call", "left").select(*df.columns, out_col, *new)


def correction_chain(df: DataFrame, stages: list[dict]) -> DataFrame:
    """Staged correction; each stage is ``{"prompt": Column builder
    (df -> Column), "factory": predictor factory, "out": column,
    "dialect": fenced-block dialect}``: render the prompt, generate, and
    extract the block into ``out``; later stages may read earlier outputs."""
    for st in stages:
        df = df.withColumn("__prompt", st["prompt"](df))
        df = batch_generate(df, "__prompt", st["factory"], "__raw").drop("__prompt", "prompt_tokens", "completion_tokens", "generation_error")
        df = df.withColumn(st["out"], extract_fenced("__raw", st.get("dialect", "stage"))).drop("__raw")
    return df


def judge_results(df: DataFrame, prompt: Callable, factory: Callable, executed_col: str = "executed_ok") -> DataFrame:
    """Judge prompt -> generation -> reasoning/content split -> JSON
    parse -> status (B26).  ``prompt(df)`` builds the judge prompt (B21 + B22)."""
    g = batch_generate(df.withColumn("__prompt", prompt(df)), "__prompt", factory, "__raw").drop("__prompt")
    sr = split_reasoning("__raw")
    v = parse_json_object(sr["content"])
    parsed = F.when(v.isNotNull(), F.struct(F.try_variant_get(v, "$.is_correct", "boolean").alias("is_correct"),
                                            F.try_variant_get(v, "$.reasoning", "string").alias("reasoning")))
    j = apply_judgment(F.coalesce(F.col(executed_col), F.lit(True)), parsed)
    return g.withColumn("judge_reasoning", sr["reasoning"]).withColumn("status", j["status"]) \
            .withColumn("judge_error", j["judge_error"]) \
            .withColumn("is_correct", parsed["is_correct"]).drop("__raw")
