"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits (or several 64-bit words): a bit is 1 if it is set in
more than half of the hashes of the text's word shingles. Fingerprints that
differ in at most ``threshold`` bits are linked. The bits are cut into
``segments`` on a ring. Two fingerprints become candidates if some segment is
equal, and stay candidates only if the differences summed over the segments
that follow it keep within l * threshold / segments after l segments, for some
segment at which such a chain starts; the full Hamming distance decides last.

With segments > threshold (op6: 3 segments, 2 bits) every linked pair has such a
chain that starts with an equal segment, so no link is lost. With wide
fingerprints and a larger threshold (the pipeline's similarity of 0.8) an equal
segment exists with a probability that `recall` gives; the chain test then
starts at any segment of the ring, which again loses nothing. There the
fingerprints only find candidates, and the sets of shingles decide (`near_groups`).

Defined results: a null text counts as empty; a text with no word has the
fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle. Null doc_ids are documents too; a component of only those has a null
id. Repeated rows are linked to each other. An empty table gives an empty one.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, components, cut, likely, named, sliced, table
from ._words import finish

#: Buckets of up to this many fingerprints are compared by shifted copies of the sorted table.
SHIFT = 256
#: Rows of the sorted table that are compared at once.
ROWS = 1 << 15
#: Larger ones, if segments > threshold, are cut again by the bits that are left, as long as those differ.
REFINE = 4096

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """The word-th further 64 bits made from each hash; the hash itself for word 0."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 with seed 42 of each k-word shingle, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(k)))), repeat(42)), np.uint64, len(w) - k + 1)


def fingerprint_batch(shingles: list[np.ndarray], words: int = 1) -> list[bytes]:
    """Big-endian fingerprints of texts' shingle hashes; counts bits through histograms of bytes, a few MB of hashes at a time."""
    counts = np.zeros((len(shingles), words * 64))
    n = np.zeros(len(shingles))
    buffer: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if not buffer:
            return
        own = sorted(set(owner))
        place = {d: i for i, d in enumerate(own)}
        h = np.concatenate(buffer)
        at = np.repeat(np.array([place[d] for d in owner], np.int64) * 256, [len(x) for x in buffer])
        for w in range(words):
            raw = _mix(h, w).astype(">u8").view(np.uint8).reshape(-1, 8)
            for b in range(8):
                hist = np.bincount(at + raw[:, b], minlength=256 * len(own)).reshape(-1, 256)
                counts[own, w * 64 + b * 8 : w * 64 + b * 8 + 8] += hist @ _BITS
        buffer.clear()
        owner.clear()

    held = 0
    for d, h in enumerate(shingles):
        n[d] = len(h)
        for s in range(0, len(h), 1 << 18):
            buffer.append(part := h[s : s + (1 << 18)])
            owner.append(d)
            held += len(part)
            if held >= 1 << 18 or len(owner) >= 512:
                flush()
                held = 0
    flush()
    return [x.tobytes() for x in np.packbits(counts * 2 > n[:, None], axis=1)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, fp binary, node long) of every row.

    Every occurrence of a shingle votes and node is the fingerprint itself (of one
    word, as a long; else a hash of it); or, if distinct, every shingle votes once
    and node is a hash of the set of shingles.
    """

    def run(batches):
        for b in sliced(batches, 1):
            h = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            if distinct:
                h = [np.unique(x) for x in h]
            fp = fingerprint_batch(h, words)
            if distinct:
                node = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in h]
            else:
                node = [int.from_bytes(x, "big", signed=True) if words == 1 else xxhash.xxh64_intdigest(x) - (1 << 63) for x in fp]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary()), pa.array(node, pa.int64())], ["id", "fp", "node"])

    bound_batches(df.sparkSession)
    kind = df.select(named(id_col)).schema[0].dataType.simpleString()
    return df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp binary, node long")


def bounds(bits: int, segments: int) -> list[tuple[int, int]]:
    return [(i * bits // segments, (i + 1) * bits // segments) for i in range(segments)]


def _segment(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo..hi (from the most significant) of each row of uint64 words."""
    out = np.zeros(len(x), np.uint64)
    for w in range(lo // 64, (hi - 1) // 64 + 1):
        a, b = max(lo, w * 64) - w * 64, min(hi, w * 64 + 64) - w * 64
        part = (x[:, w] >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1)
        out = (out << np.uint64(b - a)) | part
    return out


def pigeonring(x: np.ndarray, threshold: int, cuts: list[tuple[int, int]], length: int = 3) -> np.ndarray:
    """Which rows of x, differences of fingerprints, have a chain of viable segments and at most threshold bits.

    A ring of m numbers that sum to at most t has a start from which every l
    consecutive ones sum to at most l * t / m. Starts are tried in turn; a
    segment is counted only for rows whose chain has got there, and the whole
    distance only for rows of which some chain of `length` segments holds.
    """
    m, out = len(cuts), np.zeros(len(x), bool)
    left = np.arange(len(x))
    for start in range(m):
        alive, total = left, np.zeros(len(left), np.int64)
        for step in range(min(length, m)):
            total = total + np.bitwise_count(_segment(x[alive], *cuts[(start + step) % m]))
            holds = total * m <= (step + 1) * threshold
            alive, total = alive[holds], total[holds]
            if not len(alive):
                break
        if len(alive):
            out[alive] = np.bitwise_count(x[alive]).sum(axis=1, dtype=np.int64) <= threshold
            left = left[~np.isin(left, alive)]
    return out


def anchored(x: np.ndarray, threshold: int, cuts: list[tuple[int, int]], start: np.ndarray) -> np.ndarray:
    """As `pigeonring`, for rows of which segment `start` is equal and only chains from there count.

    With more segments than differences every pair within the threshold has a
    start of an equal segment whose chain holds, and meets in that segment's bucket.
    """
    m, alive = len(cuts), np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for step in range(m):
        for k in range(m):
            if len(rows := np.flatnonzero((start[alive] + step) % m == k)):
                total[alive[rows]] += np.bitwise_count(_segment(x[alive[rows]], *cuts[k]))
        alive = alive[total[alive] * m <= (step + 1) * threshold]
    out = np.zeros(len(x), bool)
    out[alive] = total[alive] <= threshold
    return out


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join what was not joined before: at most as many as there are rows."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.get(i, i) != i:
            up[i] = i = up.get(up[i], up[i])
        return i

    kept = []
    for i, j in pairs.tolist():
        if (p := root(i)) != (q := root(j)):
            up[p] = q
            kept.append((i, j))
    return kept


def _pieces(free: np.ndarray, n: int) -> list[np.ndarray]:
    """The free bits (a mask, one word or more) in n masks of about as many bits."""
    at = np.flatnonzero(np.unpackbits(free.astype(">u8").view(np.uint8)))
    out = []
    for part in np.array_split(at, n):
        bits = np.zeros(len(free) * 64, np.uint8)
        bits[part] = 1
        out.append(np.packbits(bits).view(">u8").astype(np.uint64))
    return out


def _large(x: np.ndarray, ids: np.ndarray, threshold: int, free: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, without its pairs.

    free: the bits that the rows may differ in. Buckets over REFINE are cut again
    by them, in one piece more than there may be differences, so that every
    linked pair has a piece in common; a piece that all rows share would give the
    bucket back and is passed over with the bits that are left. Within a bucket
    every step takes one fingerprint and all not yet reached that link to it.
    """
    if free is not None and len(ids) > REFINE:
        varies = free & np.bitwise_or.reduce(x ^ x[:1], axis=0)
        if int(np.bitwise_count(varies).sum()) > threshold + 1:
            out: list[tuple[int, int]] = []
            for piece in _pieces(varies, threshold + 1):
                key = x & piece
                order = np.lexsort(key.T)
                new = np.flatnonzero((np.diff(key[order].astype(np.int64), axis=0) != 0).any(axis=1)) + 1
                for part in np.split(order, new):
                    if 1 < len(part):
                        out += _large(x[part], ids[part], threshold, varies & ~piece)
            return _forest(np.array(out, np.int64).reshape(-1, 2))
    left, out = np.arange(len(ids)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.concatenate([np.bitwise_count(x[left[s : s + 65536]] ^ x[i]).sum(axis=1, dtype=np.int64) <= threshold for s in range(0, len(left), 65536)])
            out += [(int(ids[i]), int(ids[j])) for j in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return out


def _near_rows(key: np.ndarray, x: np.ndarray, test) -> np.ndarray:
    """Pairs of rows (i, j) in buckets of at most SHIFT rows, of a table sorted by key, for which test(differences, rows) holds."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    of = np.repeat(sizes, sizes)
    pairs = [np.empty((0, 2), np.int64)]
    rows = np.flatnonzero((of <= SHIFT) & (of > 1))
    for step in range(1, SHIFT):
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        if not len(rows):
            break
        for s in range(0, len(rows), 1 << 16):
            part = rows[s : s + (1 << 16)]
            near = part[test(x[part] ^ x[part + step], part)]
            pairs.append(np.stack([near, near + step], axis=1))
    return np.concatenate(pairs)


def _links(key: np.ndarray, ids: np.ndarray, x: np.ndarray, threshold: int, cuts: list, exact: bool) -> list[tuple[int, int]]:
    """Links within the buckets (equal keys) of a table that is sorted by key."""
    start = key >> 48 & 0xFF
    test = (lambda d, rows: anchored(d, threshold, cuts, start[rows])) if exact else (lambda d, rows: pigeonring(d, threshold, cuts))
    out = [(int(ids[i]), int(ids[j])) for i, j in _forest(_near_rows(key, x, test))]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > SHIFT], sizes[sizes > SHIFT]):
        free = np.full(x.shape[1], ~np.uint64(0)) if exact else None
        out += _large(x[s : s + n], ids[s : s + n], threshold, free)
    return out


def _words(column, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _key(x: np.ndarray, i: int, lo: int, hi: int) -> np.ndarray:
    """The bucket of segment i: its number and value, in 48 bits at most."""
    return (_segment(x, lo, hi) | np.uint64(i << 48)).astype(np.int64)


def _whole_buckets(batches, arrays, work):
    """work on the rows of whole buckets, about ROWS at a time; the first array of each batch is the sorted key."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(arrays(b))
        n += b.num_rows
        if n < ROWS or held[-1][0][-1] == held[0][0][0]:
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        at = int(np.searchsorted(whole[0], whole[0][-1]))  # the last bucket may go on
        yield from work(*(c[:at] for c in whole))
        held, n = [[c[at:] for c in whole]], len(whole[0]) - at
    if held:
        yield from work(*(np.concatenate(c) for c in zip(*held)))


def _pairs_batch(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


#: So many buckets at most are hot, so their list is small whatever the input.
HOT_BUCKETS = 1 << 16


def near_links(nodes: DataFrame, threshold: int, segments: int, words: int = 1) -> DataFrame:
    """(u, v): links between different fingerprints, enough to connect all that are connected.

    nodes: (node long, fp binary), each fingerprint once. One row per segment is
    shuffled by the segment's value and sorted; a task then reads its buckets in
    turn. Links of a bucket come as a spanning forest, so a bucket of n
    fingerprints gives at most n - 1 rows however many of them are alike. Where
    segments > threshold, a bucket that is much larger than most is dealt out by
    pieces of its other bits, one more than there may be differences.
    """
    cuts, exact = bounds(64 * words, segments), segments > threshold
    ring = cuts if words == 1 else bounds(64 * words, words)  # wide: whole words are the ring's segments
    dealt = nodes.select("node", "fp").mapInArrow(lambda batches: _deal(batches, cuts, words, {}), "key long, node long, fp binary")
    hot: dict[int, None] = {}
    if exact:
        # At most HOT_BUCKETS buckets can hold more than this.
        most = max(REFINE, nodes.count() * segments // HOT_BUCKETS)
        hot = dict.fromkeys(r[0] for r in dealt.groupBy("key").count().where(F.col("count") > most).select("key").collect())
        if hot:
            dealt = nodes.select("node", "fp").mapInArrow(lambda batches: _deal(batches, cuts, words, hot, threshold), "key long, node long, fp binary")

    def meet(batches):
        arrays = lambda b: [b.column(0).to_numpy(), b.column(1).to_numpy(), _words(b.column(2), words)]

        def work(key, ids, x):
            if e := _links(key, ids, x, threshold, ring, exact):
                yield _pairs_batch(*zip(*e))

        yield from _whole_buckets(batches, arrays, work)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")


def _deal(batches, cuts: list, words: int, hot: dict, threshold: int = 0):
    """A row for each segment; for each further piece of the bits that are left, if the segment's bucket is hot."""
    one = np.full(words, ~np.uint64(0))
    for b in sliced(batches, rows=1 << 14):
        x = _words(b.column(1), words)
        for i, (lo, hi) in enumerate(cuts):
            key = _key(x, i, lo, hi)
            cold = np.array([k not in hot for k in key.tolist()], bool) if hot else np.ones(len(key), bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[cold]), *(c.filter(pa.array(cold)) for c in b.columns)], ["key", "node", "fp"])
            if cold.all():
                continue
            rest, mine = b.filter(pa.array(~cold)), x[~cold]
            fixed = np.zeros(words * 64, np.uint8)
            fixed[lo:hi] = 1
            free = one & ~np.packbits(fixed).view(">u8").astype(np.uint64)
            for p, piece in enumerate(_pieces(free, threshold + 1)):
                with np.errstate(over="ignore"):
                    sub = (key[~cold].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ finish((mine & piece) @ np.full(words, 0xBF58476D1CE4E5B9, np.uint64) + np.uint64(p))
                # 48 bits of a hash; the segment's number stays, for the chain. Buckets that collide only cost time.
                sub = (finish(sub) >> np.uint64(16)) | np.uint64(i << 48)
                yield pa.RecordBatch.from_arrays([pa.array(sub.astype(np.int64)), *rest.columns], ["key", "node", "fp"])


def recall(similarity: float, words: int, segments: int, threshold: int) -> float:
    """Chance that a pair of this Jaccard similarity is found: an equal segment, and within the threshold."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    equal = 1 - (1 - (1 - p) ** (bits / segments)) ** segments
    sd = math.sqrt(bits * p * (1 - p))
    return equal * 0.5 * (1 + math.erf((threshold + 0.5 - bits * p) / sd / math.sqrt(2)))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, segments: int = 3, words: int = 1) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, itself included."""
    fps = cut(fingerprints(df, id_col, text_col, shingle, words))
    nodes = fps.groupBy("node", "fp").agg(F.min("id").alias("least"))
    roots = components(near_links(nodes, threshold, segments, words))
    joined = cut(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    named_ = joined.select("node", "root").join(least, "root").select("node", "component")
    return fps.join(named_, "node").select("id", "fp", "component")  # a fingerprint of very many documents is split by the skew join


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, set binary): the sorted shingle hashes of the wanted (node, i) from docs (i, text)."""

    def run(batches):
        for b in sliced(batches, 1):
            h = [np.unique(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()]
            node = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in h]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([x.tobytes() for x in h], pa.binary())], ["node", "set"])

    some = likely(docs, "i", wanted.select("i")).select("i", "text").mapInArrow(run, "node long, set binary")
    return some.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))  # equal nodes, equal sets


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """pairs (u, v) with ok: whether the two sets of shingles are as similar as that. v joins first: a hub stands in u."""

    def run(batches):
        for b in sliced(batches, 2, 3):
            a, c = (x.to_pylist() for x in b.columns[2:])
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(a, c)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = cut(_sets(docs, wanted.join(reps, "node"), shingle))
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    return cut(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, ok boolean"))


#: So many members of a group vote on its centre.
VOTES = 31


def _stars(members: DataFrame, words: int) -> DataFrame:
    """(u, v): of each group (root) of members (root, node, fp) its hub u, and each other node.

    The hub is the node nearest to the bitwise majority of some members, so that
    of a text and its many edited copies it is the text. Ties go to the smaller node.
    """
    w = Window.partitionBy("root").orderBy("node")  # nodes are hashes: any so many are a fair sample
    votes = members.withColumn("k", F.row_number().over(w)).where(F.col("k") <= VOTES).groupBy("root").agg(F.collect_list("fp").alias("fps"))

    def middle(batches):
        for b in sliced(batches, rows=4096):
            out = []
            for fps in b.column(1).to_pylist():
                bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
                out.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(fps)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["root", "centre"])

    def distance(batches):
        for b in sliced(batches, rows=1 << 14):
            d = np.bitwise_count(_words(b.column(2), words) ^ _words(b.column(3), words)).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["root", "node", "d"])

    centres = votes.mapInArrow(middle, "root long, centre binary")
    far = cut(members.join(centres, "root").select("root", "node", "fp", "centre").mapInArrow(distance, "root long, node long, d long"))
    hubs = far.groupBy("root").agg(F.min(F.struct("d", "node")).alias("h")).select("root", F.col("h.node").alias("u"))
    return far.join(hubs, "root").where("node <> u").select("u", F.col("node").alias("v"))


def _rest(members: DataFrame, threshold: int, segments: int, words: int) -> DataFrame:
    """(u, v): all candidates of the open nodes, of members (root, node, fp, open): within the threshold, in one group, with an equal segment."""
    cuts = bounds(64 * words, segments)

    def deal(batches):
        for b in sliced(batches, rows=1 << 13):
            x, root = _words(b.column(2), words), b.column(0).to_numpy().astype(np.uint64)
            for i, (lo, hi) in enumerate(cuts):
                with np.errstate(over="ignore"):
                    key = finish(finish(root) + _key(x, i, lo, hi).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *b.columns[1:], pa.array(np.full(len(key), i, np.int32))], ["key", "node", "fp", "open", "segment"])

    def meet(batches):
        arrays = lambda b: [b.column(0).to_numpy(), b.column(1).to_numpy(), _words(b.column(2), words), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()]

        def work(key, ids, x, is_open, segment):
            first = np.searchsorted(key, key)
            end = np.searchsorted(key, key, "right")
            for i in np.flatnonzero(is_open & (end - first > 1)).tolist():
                near = np.flatnonzero(np.bitwise_count(x[first[i] : end[i]] ^ x[i]).sum(axis=1, dtype=np.int64) <= threshold) + first[i]
                # Two open nodes meet once, and a pair only in the first of the segments that it has in common.
                near = near[(ids[near] > ids[i]) | ~is_open[near]]
                near = near[ids[near] != ids[i]]
                for lo, hi in cuts[: int(segment[i])]:
                    near = near[_segment(x[near] ^ x[i], lo, hi) != 0]
                if len(near):
                    yield _pairs_batch(np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i]))

        yield from _whole_buckets(batches, arrays, work)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("root", "node", "fp", "open").mapInArrow(deal, "key long, node long, fp binary, open boolean, segment int")
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, threshold: int = 98, segments: int = 40, words: int = 8) -> DataFrame:
    """(i, h, z, kept): each row's id, hash of its text, whether the id is null, and the (z, i, h) that its group keeps.

    Fingerprints of the sets of shingles that are within the threshold make loose
    groups; every link that counts is then a pair of sets of that Jaccard
    similarity or more. First each member of a loose group is compared with the
    group's hub; members that are not similar to it are compared with all members
    that share a segment with them and are within the threshold.
    """
    docs = df.select(named(id_col).alias("i"), named(text_col).alias("text"))
    tagged = fingerprints(docs.select(F.struct("i", F.xxhash64("text").alias("h")).alias("key"), "text"), "key", "text", shingle, words, distinct=True)
    fps = cut(tagged.select(F.col("id.i").alias("i"), F.col("id.h").alias("h"), "node", "fp"))
    nodes = cut(fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min(F.struct(F.col("i").isNull().alias("z"), "i", "h")).alias("least")))
    loose = components(near_links(nodes, threshold, segments, words))
    members = cut(loose.join(nodes, "node").select("root", "node", "fp", F.col("least.i").alias("i")))
    reps = members.select("node", "i")
    stars = _verified(_stars(members.select("root", "node", "fp"), words), docs, reps, shingle, similarity)
    links = stars.where("ok").select("u", "v")
    left = stars.where("not ok").select(F.col("v").alias("node"))
    if not left.isEmpty():
        open_ = left.withColumn("open", F.lit(True))
        flagged = members.select("root", "node", "fp").join(open_, "node", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        groups = flagged.where("open").select("root").distinct()
        pairs = cut(_rest(flagged.join(groups, "root", "left_semi"), threshold, segments, words))
        links = links.unionByName(_verified(pairs, docs, reps, shingle, similarity).where("ok").select("u", "v"))
    roots = components(links)
    joined = cut(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    kept = joined.groupBy("root").agg(F.min("least").alias("kept"))
    of = joined.select("node", "root").join(kept, "root").select("node", "kept")
    return fps.join(of, "node").select("i", "h", F.col("i").isNull().alias("z"), "kept")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, threshold: int = 98, segments: int = 40, words: int = 8) -> DataFrame:
    """The rows of df but for near copies: of each group one document stays, that with the smallest id.

    Similarity is Jaccard's, of the sets of word shingles; no row goes without a
    partner in its group that is so similar or more. 512 bits differ in 78 (sd 8)
    at 0.8; `recall` gives the chance that such a pair is looked at. Rows that
    repeat an id and a text stay once: that with the smallest hash of all columns
    (rows that are equal in all of them are one). Rows with a null id are kept
    only if nothing in their group has an id, and then once.
    """
    groups = near_groups(df, id_col, text_col, shingle, similarity, threshold, segments, words)
    kept = cut(groups.select(F.col("kept.i").alias("_k_i"), F.col("kept.h").alias("_k_h")).distinct())
    here = df.select(F.struct(*[named(c) for c in df.columns]).alias("_k_row"), named(id_col).alias("_d_i"), F.xxhash64(named(text_col)).alias("_d_h"))
    joined = here.join(kept, F.col("_d_i").eqNullSafe(F.col("_k_i")) & F.col("_d_h").eqNullSafe(F.col("_k_h")), "left_semi")
    back = [F.col("_k_row").getField(c).alias(c) for c in df.columns]
    if groups.groupBy("i", "h").count().where("count > 1").isEmpty():
        return joined.select(*back)
    one = joined.groupBy("_d_i", "_d_h").agg(F.min_by("_k_row", F.xxhash64(F.to_json("_k_row"))).alias("_k_row"))
    return one.select(*back)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
ORACLES: dict[str, str] = {}
