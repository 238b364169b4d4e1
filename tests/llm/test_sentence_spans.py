import random
from collections import defaultdict

import numpy as np
import pytest

from qcorpus.llm import kernel
from qcorpus.llm import sentence_spans as S
from qcorpus.llm.sentence_spans import remove_repeated_passages, remove_repeated_spans
from tests.llm.fixtures import docs, no_docs


def cut(text, max_words=16):
    """Sentences as lists of words, plainly."""
    out, now = [], []
    for line in text.replace("\v", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").split("\n"):
        for w in line.split(" "):
            if not w:
                continue
            now.append(w)
            if w[-1] in ".!?" or len(now) == max_words:
                out.append(now)
                now = []
        if now:
            out.append(now)
        now = []
    return out


def runs(sentences, min_sentences=3, min_words=20):
    found = set()
    n = len(sentences)
    for i in range(n):
        for a, step in ((i, 1), (i, -1)):
            k = a
            while 0 <= k < n:
                lo, hi = min(a, k), max(a, k) + 1
                if hi - lo >= min_sentences and sum(map(len, sentences[lo:hi])) >= min_words:
                    found.add((lo, hi))
                    break
                k += step
    return sorted(found)


def content_cut(text, width=8):
    """Pieces as lists of words: cut after stops, line ends and every word that is
    lowest in some window of ``width`` words without one."""
    words, stop = [], []
    for line in text.replace("\v", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").split("\n"):
        mine = [w for w in line.split(" ") if w]
        words += mine
        stop += [w[-1] in ".!?" or any(w.encode().endswith(c) for c in S._MORE_STOPS) for w in mine]
        if stop:
            stop[-1] = True
    if not words:
        return []
    data = text.encode()
    h = kernel.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)[3]
    with np.errstate(over="ignore"):
        keys = [int(kernel.mix(h[i:i + 1] + (np.uint64(0) if i == 0 or stop[i - 1] else h[i - 1]) * np.uint64(S._STEP))[0]) | 1
                for i in range(len(words))]
    ends = set()
    for lo in range(len(words) - width + 1):
        if not any(stop[lo:lo + width]):
            least = min(keys[lo:lo + width])
            ends |= {i for i in range(lo, lo + width) if keys[i] == least}
    out, now = [], []
    for i, w in enumerate(words):
        now.append(w)
        if stop[i] or i in ends:
            out.append(now)
            now = []
    return out + [now] if now else out


def brute(rows, cut=cut, min_sentences=3):
    """Kept words per row."""
    places = defaultdict(list)
    cuts = [cut(t or "") for _, t in rows]
    for k, (d, _) in enumerate(rows):
        for lo, hi in runs(cuts[k], min_sentences):
            places[tuple(w for s in cuts[k][lo:hi] for w in s)].append((d, k, lo, hi))
    gone = defaultdict(set)
    for where in places.values():
        keeper = min((d for d, *_ in where if d is not None), default=None)
        seen = set()
        for d, k, lo, hi in sorted(where, key=lambda x: (x[1], x[2])):
            if k in seen or (d is not None and d > keeper):
                gone[k].update(range(lo, hi))
            seen.add(k)
    return [[w for s, ws in enumerate(c) if s not in gone[k] for w in ws] for k, c in enumerate(cuts)]


@pytest.mark.parametrize("rule,options", [(remove_repeated_spans, ()), (remove_repeated_passages, (content_cut, 1))])
def test_equals_brute_force(spark, rule, options):
    df = docs(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed_words"], r["spans"]) for r in
                  rule(df).collect()), key=lambda r: str((r[0],)))
    want = defaultdict(list)
    for (d, _), words in zip(rows, brute(rows, *options)):
        want[d].append(" ".join(words))
    have = defaultdict(list)
    white = " \t\n\v\f\r"
    for d, t, n, m, _ in got:
        words = [w for w in (t or "").translate(str.maketrans(white, "      ")).split(" ") if w]
        assert len(words) == n - m
        have[d].append(" ".join(words))
    assert {d: sorted(v) for d, v in have.items()} == {d: sorted(v) for d, v in want.items()}
    assert any(m for *_, m, _ in got)


def test_spans_tell_what_went(spark):
    df = docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    before = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in remove_repeated_spans(df).collect():
        text = before[r["doc_id"]]
        kept, at = "", 0
        for s in r["spans"]:
            kept, at = kept + text[at:s["begin"]], s["end"]
        kept += (text or "")[at:]
        assert (r["text"] or "").split() == kept.split()


def test_columns_and_unchanged_texts(spark):
    df = docs(spark)
    out = remove_repeated_spans(df)
    assert out.columns == df.columns + ["n_sentences", "n_words", "n_removed", "n_removed_words", "spans"]
    same = {(r["doc_id"], r["text"]) for r in df.collect()}
    for r in out.where("n_removed = 0").collect():
        assert (r["doc_id"], r["text"]) in same


def test_empty_table(spark):
    assert remove_repeated_spans(no_docs(spark)).collect() == []


def test_passage_is_found_at_every_offset(spark):
    """A passage of 52 words in the middle of other words, with and without stops."""
    rng = random.Random(5)
    other = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    for size in (0, 5, 25):
        passage = other(52)
        if size:
            passage = [w + "." * (k % size == size - 1) for k, w in enumerate(passage)]
        rows = [(1, " ".join(other(7) + passage + other(9)))]
        rows += [(2 + k, " ".join(other(k) + passage + other(20))) for k in range(40)]
        out = {r["doc_id"]: r for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[1]["text"] == rows[0][1]
        for d, text in rows[1:]:
            left = set(out[d]["text"].split())
            assert not left & set(passage[16:-16]), (size, d)
            assert set(text.split()) - set(passage) <= left


def test_stops_of_other_scripts(spark):
    text = "एक दो तीन। चार पाँच؟ छह सात。 आठ"
    out = remove_repeated_passages(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (out["n_sentences"], out["n_words"], out["text"]) == (4, 8, text)
