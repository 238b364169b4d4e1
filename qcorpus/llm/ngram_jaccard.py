"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Two shingle sets of sizes r <= s with Jaccard similarity >= t differ in at most
H = floor((1 - t) / (1 + t) * (r + s)) shingles.  The universe of shingle
hashes is cut into segments, the same for all sets of a size band.  Giving
segment i the allowance a_i in {0, 1, 2} with sum(a_i) = H + 1, some segment
must differ in fewer than a_i shingles: with a_i = 1 it is equal in both sets,
with a_i = 2 it is equal or one side has one shingle more.  So each set is
indexed under the hash of its segment (a_i = 1), or under that hash and the
hashes of the segment with one shingle left out (a_i = 2).

*Size bands* grow by 1/t, so the smaller partner of a set lies in its band or
the next lower one; a set is indexed in its own band's scheme and in the next.

*Allocation by cost.*  Per scheme the number of two-allowances is chosen by the
exact number of sets in its bands: more of them make longer segments, which
costs index rows (one per shingle of such a segment) and saves accidental
matches (segments that are empty or tiny in both sets); see ``plan_scheme``.

*Verification.*  Every pair that shares an index key is decided, exactly, but
for pairs already connected, which cannot change a component: first one pair per
set, with the hub of its keys; then the nearest pair of each component left;
then all pairs sharing a key whose ends are still in different components.  A
parity sketch comes before each verification (the popcount of two sketches' XOR
never exceeds the symmetric difference, so no pair within H is lost).  Keys with
many sets are compared in square tiles of bounded size.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .components import connected_components
from .scratch import stored

SKETCH_BITS = 512  # fewest bits of a parity sketch
GATHER_BYTES = 4 << 20  # sketches compared at a time
TILE = 2048  # sets on one side of a tile of a crowded key
MAX_BROADCAST_ROWS = 1_000_000  # (node, doc_id) rows, 16 bytes each


def percent(threshold: float) -> Fraction:
    """The threshold as an exact fraction."""
    return Fraction(str(threshold))


def difference_bound(sizes: int, t: Fraction) -> int:
    """Largest symmetric difference of two sets with r + s = ``sizes`` and
    similarity of at least ``t``."""
    return math.floor((1 - t) / (1 + t) * sizes)


def bands(max_size: int, t: Fraction) -> list[int]:
    """Lower ends of the size bands; the last entry lies above ``max_size``."""
    ends = [1]
    while ends[-1] <= max_size:
        ends.append(max(ends[-1] + 1, math.floor(ends[-1] / t) + 1))
    return ends


def plan_scheme(low: int, high: int, n_sets: int, t: Fraction) -> tuple[int, int]:
    """(segments, segments with allowance 2) of the scheme whose larger sets
    have low <= size < high, for ``n_sets`` sets that use it.

    Cost per candidate plan: index rows, plus the matches expected by accident
    (both segments empty, or both holding one and the same frequent shingle,
    bounded by the empty case), each counted once per pair.
    """
    h = difference_bound(2 * (high - 1), t)
    best = None
    size = (low + high) / 2
    for twos in range(0, h // 2 + 1) if h < 64 else [0, *range(h // 16, h // 2 + 1, max(1, h // 16))]:
        segments = h + 1 - twos
        mean = size / segments
        rows = n_sets * (segments + twos * mean)
        accidental = n_sets / 2 * n_sets * ((segments - twos) * math.exp(-2 * mean)
                                            + twos * 2 * (1 + mean) * math.exp(-2 * mean))
        cost = rows + 4 * accidental
        if best is None or cost < best[0]:
            best = (cost, segments, twos)
    return best[1], best[2]


def _set_rows(batches, size: int):
    """(row, n_shingles, node, sketch) per text; node is the set's id."""
    for batch in batches:
        texts = batch.column("text")
        n_all, node_all, sketch_all = [], [], []
        for lo, hi, raw, offsets in kernel.slices(texts):
            _, _, text, h = kernel.words(raw, offsets)
            for values in kernel.shingles(text, h, hi - lo, size):
                n_all.append(len(values))
                node_all.append(kernel.set_id(values))
                sketch_all.append(sketch(values))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"),
            "n_shingles": pa.array(n_all, pa.int64()),
            "node": pa.array(node_all, pa.int64()),
            "sketch": pa.array(sketch_all, pa.binary())})


def sketch(values: np.ndarray) -> bytes:
    """Parity sketch: every shingle flips one of the bits, of which there are
    at least twice as many as shingles (a power of two)."""
    bits = max(SKETCH_BITS, 2 << (max(len(values), 1) - 1).bit_length())
    bit = ((kernel.mix(values + np.uint64(77)) >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def sketch_rows(data: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest one's width (a
    fold is the sketch that fewer bits would have given)."""
    width = min(map(len, data)) // 8
    rows = np.empty((len(data), width), np.uint64)
    for k, d in enumerate(data):
        x = np.frombuffer(d, np.uint64)
        while len(x) > width:
            half = len(x) // 2
            x = x[:half] ^ x[half:]
        rows[k] = x
    return rows


def segment_keys(values: np.ndarray, scheme: int, segments: int, twos: int) -> np.ndarray:
    """Index keys of one set under a scheme.  ``values`` is sorted, so a
    segment (a range of the hash universe) is a slice of it.  Segments with
    allowance 2 come first."""
    width = (1 << 64) // segments
    cuts = (np.arange(1, segments, dtype=object) * width).astype(np.uint64)
    at = np.concatenate(([0], np.searchsorted(values, cuts), [len(values)]))
    mixed = kernel.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    content = total[at[1:]] - total[at[:-1]]
    salt = kernel.mix(np.arange(segments, dtype=np.uint64) + np.uint64((scheme + 1) << 32))
    keys = kernel.mix(content ^ salt)
    if twos:
        end = at[twos]
        owner = np.repeat(np.arange(twos), np.diff(at[:twos + 1]))
        less = kernel.mix((content[owner] - mixed[:end]) ^ salt[owner])
        keys = np.concatenate([keys, less])
    return keys


def _key_rows(batches, size: int, lows: list[int], plans: dict[int, tuple[int, int]]):
    """(key, node) index rows.  Copies within a task are indexed once."""
    seen: set[int] = set()
    low_ends = np.array(lows)
    for batch in batches:
        keys, nodes = [], []
        for lo, hi, raw, offsets in kernel.slices(batch.column("text")):
            _, _, text, h = kernel.words(raw, offsets)
            for values in kernel.shingles(text, h, hi - lo, size):
                if not len(values):
                    continue
                node = kernel.set_id(values)
                if node in seen:
                    continue
                seen.add(node)
                band = int(np.searchsorted(low_ends, len(values), side="right")) - 1
                for scheme in (band, band + 1):
                    if scheme in plans:
                        k = segment_keys(values, scheme, *plans[scheme])
                        keys.append(k)
                        nodes.append(np.full(len(k), node, np.int64))
            if sum(map(len, keys)) > 200_000:
                yield _pairs_batch(keys, nodes)
                keys, nodes = [], []
        if keys:
            yield _pairs_batch(keys, nodes)


def _pairs_batch(keys, nodes):
    return pa.RecordBatch.from_pydict({"key": pa.array(kernel.signed(np.concatenate(keys))),
                                       "node": pa.array(np.concatenate(nodes))})


def _shared_rows(batches):
    """From rows sorted by (key, node): the distinct (key, node) of all keys that
    two nodes or more share.  Keeps one row between batches, never a group."""
    last = None  # key, its first node, last node, whether its first row was returned
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        node = batch.column("node").to_numpy(zero_copy_only=False)
        n = len(key)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        change = new.copy()
        change[1:] |= node[1:] != node[:-1]
        carried = last is not None and last[0] == key[0]
        if carried:
            new[0] = False
            change[0] = node[0] != last[2]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        leader = np.where(start >= 0, node[np.maximum(start, 0)], last[1] if carried else 0)
        follower = change & ~new
        group = start[follower]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        told = carried and last[3]
        if len(group) and group[0] == -1 and told:
            first[0] = False
        keys = np.concatenate([key[follower], key[follower][first]])
        nodes = np.concatenate([node[follower], leader[follower][first]])
        ends_started = bool((follower & (start == start[-1])).any())
        last = (key[-1], leader[-1], node[-1], ends_started or (told and start[-1] == -1))
        if len(keys):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "node": pa.array(nodes)})


def _own_sets(batches, size: int):
    """(node, values) of the texts asked for: rows whose text has the set id
    that the row wants."""
    for batch in batches:
        want = batch.column("node").to_numpy(zero_copy_only=False)
        nodes, data = [], []
        for lo, hi, raw, offsets in kernel.slices(batch.column("text")):
            _, _, text, h = kernel.words(raw, offsets)
            for i, values in enumerate(kernel.shingles(text, h, hi - lo, size), lo):
                if kernel.set_id(values) == want[i]:
                    nodes.append(int(want[i]))
                    data.append(values.tobytes())
        if nodes:
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "vals": pa.array(data, pa.binary())})


def _linked(batches, num: int, den: int):
    """The pairs whose sets reach the threshold num / den, exactly."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("left"), batch.column("right")
        keep = []
        for i in range(len(a)):
            x = np.frombuffer(left[i].as_buffer(), np.uint64)
            y = np.frombuffer(right[i].as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum())
            if den * common >= num * (len(x) + len(y) - common):
                keep.append(i)
        if keep:
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in keep], pa.int64()),
                                              "b": pa.array([b[i] for i in keep], pa.int64())})


def _possible(batches, t: Fraction):
    """The pairs whose sketches and sizes allow the threshold."""
    for batch in batches:
        left, right = batch.column("left_sketch").to_pylist(), batch.column("right_sketch").to_pylist()
        both = zip(left, right, batch.column("n_left").to_pylist(), batch.column("n_right").to_pylist())
        keep = []
        for x, y, m, n in both:
            rows = sketch_rows([x, y])
            keep.append(min(m, n) >= t * max(m, n)
                        and int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= difference_bound(m + n, t))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tile_pairs(batches, t: Fraction, nearest: bool):
    """From rows sorted by (key, i, j): the pairs of each tile (left rows x
    right rows, or one set of rows with itself) that lie in different components
    and may reach the threshold; with ``nearest`` only the pair of smallest
    sketch distance of each component.  Holds one tile at a time."""
    num, den = (1 - t).numerator * (1 + t).denominator, (1 - t).denominator * (1 + t).numerator
    names = ("key", "i", "j", "tile", "node", "component", "n_shingles")
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        now["sketch"] = np.array(batch.column("sketch").to_pylist(), dtype=object)
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in now}
        n = len(now["key"])
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in ("key", "i", "j"):
            new[1:] |= now[c][1:] != now[c][:-1]
        cuts = np.concatenate(([0], np.flatnonzero(new)))
        yield from _pairs_of(now, cuts[:-1], cuts[1:], t, num, den, nearest)
        rest = {c: v[cuts[-1]:] for c, v in now.items()}
    if rest is not None:
        yield from _pairs_of(rest, [0], [len(rest["key"])], t, num, den, nearest)


def _pairs_of(rows, starts, ends, t, num, den, nearest):
    found_a, found_b = [], []
    node, comp, size = rows["node"], rows["component"], rows["n_shingles"]
    for lo, hi in zip(starts, ends):
        sketches = sketch_rows(list(rows["sketch"][lo:hi]))
        same = rows["i"][lo] == rows["j"][lo]
        left = np.arange(lo, hi) if same else lo + np.flatnonzero(rows["tile"][lo:hi] == rows["i"][lo])
        right = left if same else lo + np.flatnonzero(rows["tile"][lo:hi] != rows["i"][lo])
        if not len(left) or not len(right):
            continue
        step = max(1, 200_000 // len(right))
        best: list[tuple] = []
        for k in range(0, len(left), step):
            x = left[k:k + step, None]
            ok = comp[x] != comp[right]
            if same:
                ok &= x < right
            small, big = np.minimum(size[x], size[right]), np.maximum(size[x], size[right])
            ok &= small * t.denominator >= big * t.numerator
            p, q = np.nonzero(ok)
            p, q = left[k + p], right[q]
            distance = _distances(sketches, p - lo, q - lo)
            ok = distance * den <= num * (size[p] + size[q])
            p, q, distance = p[ok], q[ok], distance[ok]
            if nearest:
                best.append((p, q, distance))
                p, q = _nearest(best, comp)
                best = [(p, q, _distances(sketches, p - lo, q - lo))]
                continue
            found_a.append(np.minimum(node[p], node[q]))
            found_b.append(np.maximum(node[p], node[q]))
        for p, q, _ in best:
            found_a.append(np.minimum(node[p], node[q]))
            found_b.append(np.maximum(node[p], node[q]))
    if found_a:
        pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
        if pairs.shape[1]:
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})


def _distances(sketches, p, q) -> np.ndarray:
    """Hamming distances of pairs of sketches, ``GATHER_BYTES`` of them at a time."""
    out = np.zeros(len(p), np.int64)
    step = max(1, GATHER_BYTES // max(1, sketches.shape[1] * sketches.itemsize))
    for k in range(0, len(p), step):
        out[k:k + step] = np.bitwise_count(sketches[p[k:k + step]] ^ sketches[q[k:k + step]]).sum(axis=1)
    return out


def _nearest(found, comp):
    """The pairs of smallest distance of each component."""
    p, q, d = (np.concatenate(x) for x in zip(*found))
    owner = np.concatenate([comp[p], comp[q]])
    pair = np.concatenate([np.arange(len(p))] * 2)
    order = np.lexsort((pair, d[pair], owner))
    owner, pair = owner[order], pair[order]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep = np.unique(pair[first])
    return p[keep], q[keep]


def ngram_jaccard_components(docs: DataFrame, threshold: float = 0.85, size: int = 4, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (and text_key,
    see ``text_key``).

    Texts are lowered (A-Z), cut into words at ASCII white space and compared
    as sets of distinct ``size``-word shingles; two documents link at a Jaccard
    similarity of at least ``threshold``.  component_id is the smallest doc_id
    reachable by links, the document's own included.

    Null, empty and blank texts have n_shingles 0 and link with nothing (copies
    of them neither).  A shorter text is one shingle.  Rows with a null doc_id
    count their shingles but take part in no link; their component_id is null.
    Rows that repeat a doc_id are separate documents with that id.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    Shingles are compared by 64-bit hashes.
    """
    t = percent(threshold)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(src.withColumn("text_key", text_key()).mapInArrow(
        lambda it: _set_rows(it, size), "doc_id long, text_key long, n_shingles long, node long, sketch binary"), "sets")
    nodes = (sets.where("n_shingles > 0 and doc_id is not null").groupBy("node")
             .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"),
                  F.first("sketch").alias("sketch")))
    nodes = stored(nodes, "nodes")
    links = _links(src, nodes, t, size, tile)
    if links is None:
        comp = nodes.select("node", F.col("rep").alias("component_id"))
    else:
        parts = connected_components(links)
        low = (parts.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("component_id")))
        comp = (nodes.select("node", "rep").join(parts, "node", "left").join(low, "component", "left")
                .select("node", F.coalesce("component_id", "rep").alias("component_id")))
    linked = F.when(F.col("n_shingles") > 0, F.col("node"))
    return (sets.withColumn("node", F.when(F.col("doc_id").isNotNull(), linked)).join(comp, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_key"))


def text_key():
    """A hash that tells apart rows of one doc_id by their text."""
    return F.xxhash64(F.col("text").cast("string"))


def drop_linked(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row per component: the one whose doc_id is the
    component's (of rows equal in doc_id and text, one).  Rows that link with
    nothing stay, those without a doc_id or without words among them."""
    found = ngram_jaccard_components(docs, **options)
    gone = (found.where("component_id < doc_id").select("doc_id", "text_key").distinct()
            .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                         F.col("doc_id").cast("long").alias("id"), text_key().alias("key"),
                         (F.length(F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))) > 0).alias("filled"))
    kept = packed.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    number = F.row_number().over(Window.partitionBy("id", "key").orderBy("id"))
    return (kept.withColumn("number", number).where("number = 1 or id is null or not filled").select("row.*"))


def _links(src: DataFrame, nodes: DataFrame, t: Fraction, size: int, tile: int) -> DataFrame | None:
    """Verified links (a, b) between nodes that connect what the threshold
    connects; None where no set can have a different partner."""
    spark = src.sparkSession
    top = nodes.agg(F.max("n_shingles")).first()[0]
    if top is None:
        return None
    ends = bands(top, t)
    low_ends = F.array(*[F.lit(x) for x in ends])
    band = F.size(F.filter(low_ends, lambda x: x <= F.col("n_shingles"))) - 1
    counts = {r["band"]: r["count"] for r in nodes.groupBy(band.alias("band")).count().collect()}  # one row per band
    plans = {}
    for s in range(len(ends) - 1):
        users = counts.get(s, 0) + counts.get(s - 1, 0)
        if counts.get(s, 0) and users > 1 and difference_bound(2 * (ends[s + 1] - 1), t) > 0:
            plans[s] = plan_scheme(ends[s], ends[s + 1], users, t)
    if not plans:
        return None
    index = src.where("doc_id is not null").mapInArrow(lambda it: _key_rows(it, size, ends, plans),
                                                       "key long, node long")
    shared = stored(index.repartition("key").sortWithinPartitions("key", "node")
                    .mapInArrow(_shared_rows, "key long, node long"), "shared")
    sized = nodes.select("node", "n_shingles", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        wanted = (pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                  .join(nodes, "node").select("node", F.col("rep").alias("doc_id")))
        wanted = stored(wanted, "wanted")
        if wanted.count() <= MAX_BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        sets = stored(src.join(wanted, "doc_id").select("node", "text")
                      .mapInArrow(lambda it: _own_sets(it, size), "node long, vals binary")
                      .dropDuplicates(["node"]), "values")
        both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("vals").alias("left")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("vals").alias("right")), "b"))
        return stored(both.select("a", "b", "left", "right").mapInArrow(
            lambda it: _linked(it, t.numerator, t.denominator), "a long, b long"), "links")

    # hubs: a set that agrees with many others, as the origin of a group of copies
    # does, leads the keys it has; every set is compared with its keys' best leader
    weight = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rank = (shared.join(weight, "key").groupBy("node").agg(F.sum("n").alias("n"))
            .select("node", F.struct("n", "node").alias("rank")))
    ranked = stored(shared.join(rank, "node"), "ranked")
    leads = ranked.groupBy("key").agg(F.max("rank").alias("lead"))
    star = (ranked.join(leads, "key").where("lead.node <> node").groupBy("node").agg(F.max("lead").alias("lead"))
            .select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct())
    star = (star.join(sized.toDF("a", "n_left", "left_sketch"), "a").join(sized.toDF("b", "n_right", "right_sketch"), "b")
            .select("a", "b", "n_left", "n_right", "left_sketch", "right_sketch")
            .mapInArrow(lambda it: _possible(it, t), "a long, b long"))
    links = verified(star)

    def across(links: DataFrame, nearest: bool) -> DataFrame:
        """Pairs that share a key and lie in different components of ``links``."""
        parts = connected_components(links)
        members = stored(shared.select("key", "node").join(parts, "node", "left")
                         .select("key", "node", F.coalesce("component", "node").alias("component")), "members")
        # keys of one and the same set of nodes ask for the same pairs: one of them stays
        open_keys = (members.groupBy("key")
                     .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("node") % (1 << 40)).alias("h1"),
                          F.expr("bit_xor(xxhash64(node, 1))").alias("h2"))
                     .where("x <> y").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
                     .select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
        rows = (members.join(open_keys, "key").join(sized, "node")
                .withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)"))
                .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
                .select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                        "tile", "node", "component", "n_shingles", "sketch"))
        return (rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                .mapInArrow(lambda it: _tile_pairs(it, t, nearest), "a long, b long").distinct())
    links = links.union(verified(across(links, nearest=True)))
    return links.union(verified(across(links, nearest=False)))
