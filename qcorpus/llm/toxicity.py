"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only documents are labelled.  Sentence i
gets p_i = sigmoid(bias + sum of the weights of its words), the document
1 - prod(1 - p_i) (noisy-or), and the weights are trained on the documents'
log-likelihood.  Afterwards the sentence scores locate the offending sentences.

A word's features are the word and its beginnings of 4 to 8 bytes, which carry
over to inflected forms.  Only features whose presence depends on the label in
the sample (likelihood ratio statistic) get a weight.

The model is fitted on a bounded sample: at most ``sample`` documents per
class, those with the smallest hash of their id, of at most ``max_bytes`` bytes
each.  All documents are scored, by whole texts.  Inputs of a score are
the words of the text and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .scratch import stored

PREFIXES = (4, 5, 6, 7, 8)
SAMPLE = 3000
MIN_STATISTIC = 15.0  # likelihood ratio of a feature that gets a weight
MAX_FEATURES = 20_000  # those of the largest statistic
MAX_TRAIN_BYTES = 200_000
LOCATE = 0.5  # score from which a sentence is reported
THRESHOLD = 0.7

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True
_PLAIN = np.arange(256, dtype=np.uint8)  # ASCII other than letters and digits becomes a space
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in training: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sentences(raw: np.ndarray, offsets: np.ndarray):
    """(features, sentence) per word and (text, first byte, end byte) per
    sentence with a word, of one slice of texts."""
    starts, ends, text, features = kernel.words(_PLAIN[raw], offsets, prefixes=PREFIXES)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return features, z, z, z, z
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_BREAK[raw], out=breaks[1:])
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    last = np.append(first[1:], len(starts)) - 1
    return features, sentence, text[first], starts[first], ends[last]


@dataclass
class NoisyOr:
    """A fitted model: sorted feature hashes, their weights, the bias."""
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.slots = np.zeros(1 << 16, bool)
        self.slots[self.features >> np.uint64(48)] = True

    def known(self, features: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, sentence) of the words' features that the model has."""
        numbers, owners = [], []
        if len(self.features):
            for row in features:
                at = np.flatnonzero(self.slots[row >> np.uint64(48)])
                k = np.minimum(np.searchsorted(self.features, row[at]), len(self.features) - 1)
                same = self.features[k] == row[at]
                numbers.append(k[same])
                owners.append(sentence[at[same]])
        if not numbers:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(numbers), np.concatenate(owners)

    def sentence_scores(self, features: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        number, owner = self.known(features, sentence)
        z = np.bincount(owner, weights=self.weights[number], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(features: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, rounds: int = 250,
        rate: float = 0.15, decay: float = 1e-4, rate_positive: float = 0.3) -> NoisyOr:
    """Fit the weights of ``features`` to document labels; a bag is (feature
    numbers, their sentences, number of sentences).  Classes weigh as if
    ``rate_positive`` of the documents were positive."""
    y = labels.astype(float)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return NoisyOr(np.zeros(0, np.uint64), np.zeros(0), -12.0 if share == 0 else 12.0)
    sizes = np.array([b[2] for b in bags])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    word = np.concatenate([b[0] for b in bags])
    owner = np.concatenate([b[1] + at for b, at in zip(bags, begin)])
    bag_of = np.repeat(np.arange(len(bags)), sizes)
    k, n = len(features), int(begin[-1])
    weight = np.where(y == 1, rate_positive / share, (1 - rate_positive) / (1 - share))
    w, b = np.zeros(k), -5.0
    moment, speed = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weights=w[word], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(bag_of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        none = np.minimum(none, -1e-9)  # log of the chance that no sentence offends
        pull = np.where(y == 1, -np.exp(none) / -np.expm1(none), 1.0) * weight
        dz = p * pull[bag_of]
        grad = np.append(np.bincount(word, weights=dz[owner], minlength=k), dz.sum()) / len(y)
        grad[:-1] += decay * w
        moment = 0.9 * moment + 0.1 * grad
        speed = 0.999 * speed + 0.001 * grad * grad
        move = rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(speed / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return NoisyOr(features, w, float(b))


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The statistic of independence of presence and label (G)."""
    total = np.zeros(len(pos))
    for have, n in ((pos, n_pos), (neg, n_neg)):
        for seen, both in ((have, pos + neg), (n - have, n_pos + n_neg - pos - neg)):
            expected = both * (n / (n_pos + n_neg))
            total += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)
    return total


def _presence(batches):
    """(feature, pos, neg): documents of a task that have the feature."""
    parts = {0: [], 1: []}
    for batch in batches:
        labels = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi, raw, offsets in kernel.slices(batch.column("text")):
            features, sentence, text, _, _ = _sentences(raw, offsets)
            at = np.searchsorted(text[sentence] if len(sentence) else text, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                parts[int(labels[lo + k])].append(kernel.unique(features[:, at[k]:at[k + 1]].ravel()))
    keys, counts = {}, {}
    for label, found in parts.items():
        keys[label], counts[label] = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    for label in (0, 1):
        n = np.zeros(len(keys[label]), np.int64)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(kernel.signed(keys[label])),
                                          "pos": pa.array(counts[label] if label else n),
                                          "neg": pa.array(n if label else counts[label])})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_bytes: int = MAX_TRAIN_BYTES) -> NoisyOr:
    """Fit on the labelled rows that are not held out (see the module)."""
    known = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .withColumn("h", F.xxhash64("doc_id")))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where("octet_length(text) between 1 and " + str(max_bytes))
             .join(F.broadcast(chosen), "doc_id").select("h", "toxic", "text"))  # at most 2 * sample rows
    texts = stored(texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "h"), "sample")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    seen = (texts.mapInArrow(_presence, "feature long, pos long, neg long")
            .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where("pos + neg >= 3 and feature <> 0"))

    def rated(batches):
        for batch in batches:
            pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "neg"))
            g = likelihood_ratio(pos, neg, n.get(1, 0), n.get(0, 0))
            yield pa.RecordBatch.from_pydict({"feature": batch.column("feature"), "g": pa.array(g)}).filter(
                pa.array(g >= MIN_STATISTIC))
    chosen = seen.mapInArrow(rated, "feature long, g double").orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()
    features = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))
    blank = NoisyOr(features, np.zeros(len(features)), 0.0)

    def bags(batches):
        for batch in batches:
            numbers, owners, sizes = [], [], []
            for lo, hi, raw, offsets in kernel.slices(batch.column("text")):
                found, sentence, text, _, _ = _sentences(raw, offsets)
                number, owner = blank.known(found, sentence)
                order = np.argsort(owner, kind="stable")
                number, owner = number[order], owner[order]
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                cut = np.searchsorted(owner, at)
                for k in range(hi - lo):
                    numbers.append(number[cut[k]:cut[k + 1]].astype(np.int32).tobytes())
                    owners.append((owner[cut[k]:cut[k + 1]] - at[k]).astype(np.int32).tobytes())
                    sizes.append(int(at[k + 1] - at[k]))
            yield pa.RecordBatch.from_pydict({
                "h": batch.column("h"), "toxic": batch.column("toxic"), "number": pa.array(numbers, pa.binary()),
                "owner": pa.array(owners, pa.binary()), "size": pa.array(sizes, pa.int32())})
    rows = texts.mapInArrow(bags, "h long, toxic int, number binary, owner binary, size int").collect()  # the sample
    rows = sorted((r["h"], r["toxic"], bytes(r["number"]), bytes(r["owner"]), r["size"]) for r in rows)
    return fit(features, [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(o, np.int32).astype(np.int64), k)
                          for _, _, a, o, k in rows], np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD, locate: float = LOCATE) -> DataFrame:
    """``docs`` with score, predicted, n_sentences and offending: the
    sentences (code point offsets begin and end, and their score) from
    ``locate`` up; columns of ``docs`` with these names are replaced.

    Null, empty and wordless texts have no sentence and score 0.  Repeated rows
    score alike.  An empty table gives an empty result.
    """
    known, weights, bias = model.features, model.weights, model.bias
    spot = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType())])
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                          T.StructField("n_sentences", T.LongType()), T.StructField("offending", T.ArrayType(spot))])
    names = [c for c in docs.columns if c not in added.names]
    packed = docs.select(F.struct(*[docs[c] for c in names if c != "text"]).alias("row"),
                         docs["text"].cast("string").alias("text"))

    def scored(batches):
        own = NoisyOr(known, weights, bias)
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(added["offending"].dataType)
        for batch in batches:
            scores, counts, places = [], [], []
            for lo, hi, raw, offsets in kernel.slices(batch.column("text")):
                features, sentence, text, begin, end = _sentences(raw, offsets)
                p = own.sentence_scores(features, sentence, len(text))
                none = np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=hi - lo)
                scores.append(-np.expm1(none))
                counts.append(np.bincount(text, minlength=hi - lo))
                found: list[list] = [[] for _ in range(hi - lo)]
                hot = np.flatnonzero(p >= locate)
                if len(hot):
                    chars = np.zeros(len(raw) + 1, np.int64)
                    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
                    for i in hot:
                        base = chars[offsets[text[i]]]
                        found[text[i]].append({"begin": int(chars[begin[i]] - base), "end": int(chars[end[i]] - base),
                                               "score": float(p[i])})
                places += found
            value = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(value), pa.array((value >= threshold).astype(np.int32)),
                 pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)), pa.array(places, kind)],
                names=["row", "text", *added.names])
    schema = T.StructType([packed.schema["row"], packed.schema["text"], *added.fields])
    out = packed.mapInArrow(scored, schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names], *added.names)
