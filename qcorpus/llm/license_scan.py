"""License scan by a positional index of rare words.

The standard headers and grants of common licences are indexed by word position.
Their words get an inverse document frequency over all documents.  Each notice is
looked up by the highest-IDF words of its rarest key phrase; every occurrence at
file position f of such a word, at position p of the notice, votes for the
alignment (notice, f - p).  Alignments with two votes are candidates.  Every key
phrase must stand word for word within ``WINDOW`` words of its place, so that a
word put in or left out elsewhere does not lose a notice, and the notice's words
must be there to ``MIN_COVERAGE`` of their IDF.  A notice that is confirmed has all
votes of its looked-up words, so none is missed whatever else the file holds.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the base labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Licence notices (label, words, mandatory key phrases of two words or more).
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the terms of the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ("permission is hereby granted", "free of charge")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
             "liable for any damages arising from the use of this software",
     ("without any express or implied warranty", "authors be held liable")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use", "source and binary forms")),
    ("bsd", "redistribution and use of this software in source and binary forms with or without modification are permitted",
     ("redistribution and use", "source and binary forms")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software", ("neither the name", "endorse or promote products")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license 2 0", ("apache license 2 0",)),
    ("gpl-2", "gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license",
     ("gnu general public license", "free software foundation", "version 2")),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license",
     ("gnu general public license", "free software foundation", "version 3")),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", ("lesser general public license", "version 2 1")),
    ("lgpl-3", "gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
     ("lesser general public license", "free software foundation", "version 2 1")),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license",
     ("lesser general public license", "free software foundation", "version 3")),
    ("agpl-3", "gnu affero general public license version 3", ("affero general public license", "version 3")),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license",
     ("affero general public license", "free software foundation", "version 3")),
    ("gfdl", "gnu free documentation license", ("free documentation license",)),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license", "2 0")),
    ("mpl-1.1", "mozilla public license version 1 1", ("mozilla public license", "1 1")),
    ("epl-2", "eclipse public license version 2 0", ("eclipse public license", "2 0")),
    ("artistic-2", "artistic license version 2 0", ("artistic license", "2 0")),
    ("bsl-1", "boost software license version 1 0", ("boost software license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "creative commons attribution 4 0 international", ("creative commons attribution 4",)),
    ("cc-by", "creative commons attribution 3 0 unported", ("creative commons attribution 3",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international", ("creative commons attribution noderivatives",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ("creative commons attribution noncommercial",)),
)
RARE_WORDS = 3  # highest-IDF words of the rarest key phrase looked up per notice
WINDOW = 2  # words by which a key phrase may be out of its place
MIN_COVERAGE = 0.6  # IDF share of a notice's words that stand there

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lowered.  ``lower`` also changes other letters, which stay outside
    ASCII but for the Kelvin sign and the dotted capital I; texts with these
    take the slower exact form."""
    return F.when(text.rlike("[Kİ]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in NOTICES for w in words.split()}
                  | {w for phrase, _ in BASE_PHRASES for w in phrase.split()})


def _words(docs: DataFrame, row: list) -> DataFrame:
    """Columns ``row`` and w (all words).  Words are what stands between runs of
    other characters, which costs half as much as to match the words."""
    df = docs.select(*row, lowered(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("t"))
    return df.select("row", F.array_remove(F.split("t", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "").alias("w"))


def _hits(wanted: list[str]) -> Column:
    """The ``wanted`` words of column w and their places."""
    return F.filter(F.transform("w", lambda x, i: F.when(
        x.isin(wanted), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull())


def _phrase_at(first: Column, phrase: str) -> Column:
    """Does ``phrase`` stand in column w from position ``first``?"""
    test = F.lit(True)
    for k, word in enumerate(phrase.split()):
        test = test & F.coalesce(F.get("w", first + k) == word, F.lit(False))
    return test


def _start(parts: list[str], phrase: str) -> int:
    """The position of ``phrase`` among the words of a notice."""
    return [parts[k:k + len(phrase.split())] for k in range(len(parts))].index(phrase.split())


def _places(phrase: str) -> Column:
    """The hits at which ``phrase`` begins."""
    return F.filter("hits", lambda h: (h["w"] == phrase.split()[0]) & _phrase_at(h["i"], phrase))


def scan_licenses(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all by default) with n_words, n_base,
    first_word, last_word, base_labels, labels and score; columns of ``docs``
    with these names are left out.

    n_base counts the places of all base phrases, first_word and last_word are
    their smallest and largest start (null without any), base_labels and labels
    are sorted, distinct and joined by commas (empty without any).  ``score`` is
    the IDF share of the best confirmed notice's words that stand there, or
    1.0 if a base phrase was found and no notice is better.  Null and empty
    texts have no words.  Repeated rows are scanned alike; an empty table gives
    an empty result.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    names = [c for c in (columns or docs.columns) if c not in added]
    words = vocabulary()
    counted = (_words(docs, [F.lit(0).alias("row")])
               .select(F.explode_outer(F.array_intersect("w", F.array(*[F.lit(w) for w in words]))).alias("w"))
               .groupBy("w").count())
    seen = {r["w"]: r["count"] for r in counted.collect()}  # one row per notice word
    total = docs.count()
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in words}

    # looked-up words: (notice, position) of the rarest words of each notice's rarest key phrase
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, (_, notice, phrases) in enumerate(NOTICES):
        parts = notice.split()
        anchor = max(phrases, key=lambda phrase: sum(idf[w] for w in phrase.split()))
        places = [_start(parts, anchor) + k for k in range(len(anchor.split()))]
        for w in sorted({parts[p] for p in places}, key=lambda w: (-idf[w], w))[:RARE_WORDS]:
            postings.setdefault(w, []).extend((n, p) for p in places if parts[p] == w)
    rare = sorted(postings)

    looked_up = sorted({*rare, *(phrase.split()[0] for phrase, _ in BASE_PHRASES)})
    df = _words(docs, [F.struct(*[docs[c].alias(f"in_{c}") for c in names]).alias("row")])
    df = df.withColumn("hits", _hits(looked_up))
    order = F.array(*[F.lit(w) for w in rare])
    by_rank = F.array(*[F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in postings[w]])
                        for w in rare])
    df = df.withColumn("votes", F.array_sort(F.flatten(F.transform(
        F.filter("hits", lambda h: h["w"].isin(rare)),
        lambda h: F.transform(F.element_at(by_rank, F.array_position(order, h["w"]).cast("int")),
                              lambda q: F.struct(q["n"].alias("n"), (h["i"] - q["p"]).alias("at"), h["w"].alias("w")))))))
    df = df.withColumn("aligned", F.array_distinct(F.transform(
        F.filter("votes", lambda v, i: F.coalesce(
            F.when(i > 0, (F.get("votes", i - 1)["n"] == v["n"]) & (F.get("votes", i - 1)["at"] == v["at"])), F.lit(False))),
        lambda v: F.struct(v["n"].alias("n"), v["at"].alias("at")))))

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])
    notices = F.array(*[F.struct(
        F.array(*[F.struct(F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for w in notice.split()]).alias("words"),
        F.lit(sum(idf[w] for w in notice.split())).alias("whole"),
        F.array(*[F.struct(F.lit(_start(notice.split(), ph)).alias("start"), texts(ph.split()).alias("words"))
                  for ph in phrases]).alias("phrases")) for _, notice, phrases in NOTICES])

    def confirmed(a: Column) -> Column:
        """IDF share of the notice's words that stand there, null unless all key phrases do."""
        notice = F.element_at(notices, a["n"] + 1)
        shifts = F.sequence(F.lit(-WINDOW), F.lit(WINDOW))
        test = F.forall(notice["phrases"], lambda ph: F.exists(shifts, lambda s: F.when(
            a["at"] + ph["start"] + s >= 0,
            F.slice("w", a["at"] + ph["start"] + s + 1, F.size(ph["words"])) == ph["words"]).otherwise(F.lit(False))))
        first = F.greatest(a["at"] - WINDOW, F.lit(0))
        there = F.slice("w", first + 1, a["at"] + F.size(notice["words"]) + WINDOW - first)
        held = F.aggregate(notice["words"], F.lit(0.0), lambda acc, x: acc + F.when(
            F.array_contains(there, x["w"]), x["idf"]).otherwise(0.0))
        return F.when(test, held / notice["whole"])
    labels = F.array(*[F.lit(label) for label, _, _ in NOTICES])
    df = df.withColumn("found", F.filter(F.transform("aligned", lambda a: F.struct(
        F.element_at(labels, a["n"] + 1).alias("label"), confirmed(a).alias("share"))),
        lambda f: f["share"] >= MIN_COVERAGE))
    for k, (phrase, label) in enumerate(BASE_PHRASES):
        df = df.withColumn(f"base{k}", F.transform(_places(phrase), lambda h: h["i"]))
    starts = [F.col(f"base{k}") for k in range(len(BASE_PHRASES))]
    df = df.withColumn("places", F.concat(*starts))
    df = df.withColumn("base", F.concat(*[F.when(F.size(s) > 0, F.array(F.lit(label))).otherwise(
        F.array().cast("array<string>")) for s, (_, label) in zip(starts, BASE_PHRASES)]))
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    # a column that is not deterministic keeps later filters from being pushed below,
    # where every step would be computed again for each of its uses
    out = F.when(F.monotonically_increasing_id() >= 0, F.struct(
        F.size("w").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda f: f["label"])))), ",")
        .alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0))).alias("score")))
    return df.select("row", out.alias("out")).select(*[F.col("row")[f"in_{c}"].alias(c) for c in names], "out.*")
