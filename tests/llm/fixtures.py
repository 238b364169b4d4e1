"""Small inputs with the hard cases: nulls, empty and long texts, ties,
repeated rows, other scripts, and columns that clash with added ones."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, node long"
WORDS = "the of and in to river stone über façade クジラ a was house green seven walk light paper under".split()


def sentence(rng, n):
    words = [rng.choice(WORDS) + rng.choice(["", "", "x", "ing", "ers"]) for _ in range(n)]
    return " ".join(words).capitalize() + rng.choice([".", "!", "?"])


def text(rng, sentences):
    return rng.choice([" ", "\n"]).join(sentence(rng, rng.randint(3, 14)) for _ in range(sentences))


def doc_rows(seed=1):
    rng = random.Random(seed)
    texts = [text(rng, rng.randint(1, 25)) for _ in range(24)]
    for k in range(8):  # near copies: a few words differ
        words = texts[k].split(" ")
        for _ in range(1 + k % 3):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + "q"
        texts.append(" ".join(words))
    passage = " ".join(sentence(rng, 13) for _ in range(5))
    texts += [texts[20] + "\n" + passage + "\n" + texts[21], passage, text(rng, 3) + "\n" + passage]
    texts += [texts[0], texts[0], texts[1]]  # exact copies
    texts += [None, "", " \t\n ", "one", "two words", "One two THREE", "one two three", "x" * 5000,
              " ".join(["loop and again"] * 3000), text(rng, 900), "Kelvin sign, dotted İ and MIT", " nbsp　wide "]
    rows = [(10 + k, t, ["en", "de", None, "xx"][k % 4], ["b", "a", None, "c"][min(k % 7, 3)], len(t or ""), 0.5, "r", 7)
            for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", 1, None, None, None), (None, None, None, None, None, None, None, None),
             rows[3], rows[3]]
    return rows


def docs(spark, seed=1):
    return spark.createDataFrame(doc_rows(seed), DOCS).repartition(5)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
