"""Quality rules: repetition and length, and distribution divergence.

Each text gives two histograms: character classes, and the most common words
of a few languages (with one bin for all other words).  The same histograms,
summed over all documents of a language that pass the base rules, are the
language's reference; it is formed anew, twice, without the documents that are
far from the one before, so that junk does not shape it.  A document whose Jensen-Shannon distance to its nearest
reference exceeds a threshold is rejected, if it is long enough for its
histogram to mean anything.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

# The most common words of each language.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit des",
    "en": "the of and to in is that for was on",
    "es": "de la que el en y los del se las",
    "fr": "de la le et les des en un une du",
}
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
# (characters from which it holds, largest class distance): short texts vary more
CLASS_LIMITS = ((200, 0.40), (600, 0.23), (1200, 0.15))
MIN_HISTOGRAM_WORDS, MAX_WORD_DISTANCE = 100, 0.29
TRIM = (0.30, 0.18)  # class distances up to which a document shapes the next references

_WHITE = r"\x20\x09-\x0D"
CLASSES = ("lower", "white", "other_script", "upper", "digit", "symbol", "punctuation", "rest")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _features(docs: DataFrame, passed: Sequence[str]) -> DataFrame:
    """The columns ``passed`` with the base counts and both histograms.  Each
    step is a projection of its own, as the next one uses its values more than
    once."""
    keep = [F.col("row")]
    lists = [w.capitalize() for w in vocabulary()] + vocabulary() + [w.upper() for w in vocabulary() if len(w) == 1]
    df = docs.select(F.struct(*[docs[c] for c in passed]).alias("row"),
                     F.coalesce(docs["text"].cast("string"), F.lit("")).alias("t"))
    spaced = F.col("t")
    for white in "\t\n\v\f\r":
        spaced = F.replace(spaced, F.lit(white), F.lit(" "))
    df = df.select(*keep, "t", F.array_remove(F.split(spaced, " "), "").alias("w"),
                   F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{_WHITE}]")).alias("lines"))
    df = df.select(*keep, "t", F.size("w").cast("long").alias("n_words"),
                   F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
                   F.concat(F.lit("|"), F.lower(F.array_join(F.filter("w", lambda x: x.isin(lists)), "||")),
                            F.lit("|")).alias("hits"))
    # hashes of runs of 2, 4 and 8 words, each from two of half the length
    size = 1
    while size < WINDOW:
        df = df.withColumn(f"h{2 * size}", F.when(F.size(f"h{size}") > size, F.zip_with(
            F.slice(f"h{size}", 1, F.size(f"h{size}") - size), F.slice(f"h{size}", size + 1, F.size(f"h{size}")),
            lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))).drop(f"h{size}")
        size *= 2
    df = df.withColumnRenamed(f"h{WINDOW}", "win")
    # windows found twice or more: neighbours after sorting by hash
    df = df.withColumn("pairs", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(
        F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("win")
    same = lambda x, i: F.coalesce(F.get("pairs", i)["h"] == x["h"], F.lit(False))
    df = df.withColumn("at", F.array_sort(F.transform(
        F.filter("pairs", lambda x, i: same(x, i + 1) | (F.when(i > 0, same(x, i - 1)).otherwise(False))),
        lambda x: x["p"]))).drop("pairs")
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0).cast("long"))).drop("at")
    # character classes: letters and white space go first, the rest is short
    df = df.withColumn("left", F.regexp_replace("t", f"[a-z{_WHITE}]+", ""))
    white = F.length("t").cast("long") - F.col("word_chars")
    df = df.select(*[c for c in df.columns if c != "t"], white.alias("c_white"),
                   (F.col("word_chars") - F.length("left")).alias("c_lower"))
    patterns = (r"[^\x00-\x7F]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", "[.,;:!?'\"()-]+")
    for name, pattern in zip(CLASSES[2:], patterns):
        df = df.withColumn("next", F.regexp_replace("left", pattern, ""))
        df = (df.withColumn(f"c_{name}", (F.length("left") - F.length("next")).cast("long"))
              .drop("left").withColumnRenamed("next", "left"))
    counts = [*[F.col(f"c_{name}") for name in CLASSES[:-1]], F.length("left").cast("long")]
    bins = [((F.length("hits") - F.length(F.replace("hits", F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("long")
            for w in vocabulary()]
    return df.select(*keep, "n_words", "word_chars",
                     F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                     F.array(*counts).alias("classes"), F.array(*bins).alias("common"))


def _total(counts: Column | str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _distance(counts: Column, total: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram and a reference.
    ``total`` is the histogram's sum, a stored column: an expression would be
    computed again for every bin."""
    q = F.array(*[F.lit(float(x)) for x in reference])

    def part(x: Column, y: Column) -> Column:
        p = x / total
        m = (p + y) / 2
        return (F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
                + F.when(y > 0, y * F.log2(y / m)).otherwise(F.lit(0.0))) / 2
    divergence = F.aggregate(F.zip_with(counts, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, columns: Sequence[str] | None = None,
                  class_limits: Sequence[tuple[int, float]] = CLASS_LIMITS,
                  max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The ``columns`` of ``docs`` (all by default) with n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance,
    base_failed and kept; columns of ``docs`` with these names are left out.

    Words are the runs of characters other than ASCII white space.
    ``base_failed``: fewer than 20 words, or more than 30 % of the words in
    8-word windows that the text holds twice or more (windows are compared by
    64-bit hashes).  ``kept`` is false where ``base_failed``; else false where
    the class histogram of a text of at least 200 (600, 1200) characters is
    farther than 0.40 (0.23, 0.15), or the common word histogram of one of at
    least 100 words farther than 0.29, from the references of all languages.  Shorter texts pass by the length guard.

    Null and empty texts have counts 0 and fail the base rules.  The column
    ``lang`` only groups the references; rows whose lang is null or has no word
    list belong to no reference.  They are still measured against all, but a row
    whose lang is named and has no reference is kept whatever its distances.  With no
    reference at all (an empty table, or no such lang) distances are 0.
    Repeated rows are judged alike.
    """
    added = [*FEATURES, "class_distance", "word_distance", "base_failed", "kept"]
    names = [c for c in (columns or docs.columns) if c not in added]
    lang = [docs["lang"].cast("string").alias("group")] if "lang" in docs.columns else [F.lit(None).cast("string").alias("group")]
    wide = docs.select(*[docs[c].alias(f"in_{c}") for c in names], *lang, docs["text"].alias("text"))

    def features(passed: Sequence[str]) -> DataFrame:
        # a column that is not deterministic keeps later filters from being pushed below,
        # where every step would be computed again for each of its uses
        out = _features(wide, passed).withColumn("step", F.monotonically_increasing_id())
        return (out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                               | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
                .withColumn("common", F.concat("common", F.array(F.col("n_words") - _total("common"))))
                .withColumn("n_classes", _total("classes")).withColumn("n_common", _total("common")))
    # features are computed once and written with the columns asked for; the references read the histograms only
    f = stored(features([*[f"in_{c}" for c in names], "group"]), "features")
    n_bins = len(vocabulary())

    def measured(sums, rows: DataFrame) -> DataFrame:
        def nearest(column: str) -> Column:
            each = [_distance(F.col(column), F.col(f"n_{column}"), [v / sum(r[column]) for v in r[column]]) for r in sums]
            return F.lit(0.0) if not each else each[0] if len(each) == 1 else F.least(*each)
        return rows.withColumn("class_distance", nearest("classes")).withColumn("word_distance", nearest("common"))

    def references(rows: DataFrame):
        return (rows.where(~F.col("base_failed") & F.col("row.group").isin(*COMMON_WORDS))
                .groupBy(F.col("row.group").alias("lang"))
                .agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES))]).alias("classes"),
                     F.array(*[F.sum(F.col("common")[i]) for i in range(n_bins + 1)]).alias("common"))
                .orderBy("lang").collect())  # one row per language with a word list
    # documents far from a first reference do not shape the next ones
    sums = references(f)
    for limit in TRIM:
        sums = references(measured(sums, f).where(F.col("class_distance") <= limit)) or sums
    f = measured(sums, f)
    chars = F.col("n_classes")
    odd = (F.col("n_words") >= MIN_HISTOGRAM_WORDS) & (F.col("word_distance") > max_word_distance)
    for least, limit in class_limits:
        odd = odd | ((chars >= least) & (F.col("class_distance") > limit))
    # a text of a named language without a reference cannot be held against one
    group = F.col("row.group")
    odd = odd & (group.isNull() | group.isin(*[r["lang"] for r in sums]))
    return f.select(*[F.col("row")[f"in_{c}"].alias(c) for c in names], *FEATURES, "class_distance", "word_distance",
                    "base_failed", (~F.col("base_failed") & ~odd & (F.col("step") >= 0)).alias("kept"))


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their own columns.

    A verdict depends on text and lang alone, so it is stored under a 128-bit
    hash of them; texts are not written a second time.  Rows without a text go, as
    the rules reject it.
    """
    judged = [docs[c].cast("string") for c in ("text", "lang") if c in docs.columns]
    keys = [F.xxhash64(*judged).alias("key1"), F.xxhash64(F.lit(1), *judged).alias("key2")]
    slim = docs.select(*[docs[c] for c in ("text", "lang") if c in docs.columns], *keys)
    gone = quality_rules(slim, ["key1", "key2"], **options).where("not kept").select("key1", "key2").distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keys)
    return packed.join(gone, ["key1", "key2"], "left_anti").select("row.*")
