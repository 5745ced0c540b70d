"""Substring dedup by content-defined chunking with a gear rolling hash.

A boundary falls after a byte where the gear hash of the last 16 bytes (from 16
on) has its low `bits` bits zero, so equal passages are cut alike wherever they
stand, whatever was inserted before them. A chunk of more than LONG bytes that
repeats its words is cut again before its word of least hash, wherever that stands in it. Units of chunks (each chunk with those after it, up to
UNIT bytes) are deduplicated by digest: the first occurrence (smallest id, then place) is the
original, all others repeat it.

A repeat is a passage of `min_words` words at least that stands in another document
too. Two steps find them:
1. Chunks that run on one alignment with the first document that holds them are
   extended on the two texts themselves, by at most SLACK bytes at either end.
2. The first documents that hold a passage's chunks may be others that hold only
   parts of it. So where chunks that other documents hold too, whichever, run on
   for `min_words` words, and the first step has not found the passage, every
   window of `min_words` words is keyed. All texts are searched for those keys, and
   a window leads to the first document that holds just that window.
So each document that shares a window is told of it, or of a longer passage around it
or over part of it. Of windows that overlap with equal ones, as in a word that is
repeated over and over, the first leads on.

Defined results: words are parted by ASCII white space, so scripts that do not use
it have few, and a passage of them counts only by those. Passages are equal byte by
byte. A null or empty text has no chunks. Chunks that repeat only within a document do
not count. Rows that repeat an id and a text are one document; where ids repeat with
other texts, or are null, each text is a document of its own and is reported with
the id that it has. An empty table gives an empty one. Columns other than id and text
pass through unread.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Bitmap, bound_batches, cut, known, likely, named, sliced, table
from ._words import spans_hashed

BITS = 5
MAX_BYTES = 1024
#: Longer chunks whose words occur twice or more on average are cut again by them.
LONG = 64
#: Bytes by which a run of chunks is extended at most.
SLACK = 512
_WORD = re.compile(rb"[^\t-\r ]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_table(seed: int = 2) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def _recut(raw: bytes, start: int, end: int) -> np.ndarray:
    """Places between start and end: before each word of least hash but the first word, and again in pieces that are still long."""
    found = raw[start:end].split()
    if 2 * len(set(found)) > len(found):
        return np.empty(0, np.int64)  # it does not repeat itself
    words = [(m.start() + start, zlib.crc32(m[0])) for m in _WORD.finditer(raw[start:end])]
    at, hashes = np.array([w[0] for w in words], np.int64), np.array([w[1] for w in words], np.int64)
    out, todo = [], [(start, end)]
    while todo:
        lo, hi = todo.pop()
        i, j = np.searchsorted(at, [lo + 1, hi])
        if i == j:
            continue
        cuts = at[i:j][hashes[i:j] == hashes[i:j].min()]
        out.append(cuts)
        edge = np.r_[lo, cuts, hi]
        todo += [(int(edge[k]), int(edge[k + 1])) for k in np.flatnonzero(np.diff(edge) > LONG)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def gear_ends(raw: bytes, gear: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Where the rolling hash ends chunks. h[i] = sum of gear[raw[i - k]] << k for k < 16, by doubling; a boundary is a zero in its top bits of 16."""
    b = np.frombuffer(raw, np.uint8)
    h = gear[b] & np.uint32(0xFFFF)
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    end = np.flatnonzero((h & np.uint32(0xFFFF)) < (1 << (16 - bits))) + 1
    return np.concatenate((end[end < len(b)], [len(b)]))


def boundaries(raw: bytes, gear: np.ndarray, bits: int = BITS, most: int = MAX_BYTES, end: np.ndarray | None = None) -> np.ndarray:
    """Ends of the chunks: those of the rolling hash, and within long ones."""
    end = gear_ends(raw, gear, bits) if end is None else end
    size = np.diff(np.concatenate(([0], end)))
    if size.max(initial=0) > LONG:
        more = [_recut(raw, e - n, e) for e, n in zip(end[size > LONG].tolist(), size[size > LONG].tolist())]
        end = np.sort(np.concatenate((end, *more)))
    size = np.diff(np.concatenate(([0], end)))
    if size.max(initial=0) > most:  # no boundary for long: cut at fixed steps from the last one
        out = []
        for e, n in zip(end.tolist(), size.tolist()):
            out += range(e - n + most, e, most)
            out.append(e)
        end = np.array(out)
    return end


def chunk_batch(texts: list, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit: row, digest, and in one number (`unpacked` takes it apart) its start and size, and what tells how many words a passage may hold.

    A unit begins at each chunk and takes in those after it until it has UNIT bytes:
    smaller pieces of text are alike by chance too often.
    """
    rows, digests, ats = [np.empty(0, np.int64)], [], [np.empty(0, np.int64)]
    for r, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        wide = gear_ends(raw, gear)
        edge = np.r_[0, boundaries(raw, gear, end=wide)]
        to = np.searchsorted(edge, edge[:-1] + UNIT)
        start, end = edge[:-1][to < len(edge)], edge[to[to < len(edge)]]
        space = _SPACE[np.frombuffer(raw, np.uint8)]
        first = ~space
        first[1:] &= space[:-1]
        total = np.r_[0, np.cumsum(first, dtype=np.int64)]
        lo, hi = _around(start, end, np.r_[0, wide])
        before, upto = total[start] - total[lo], total[hi] - total[start]
        digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]
        rows.append(np.full(len(end), r))
        ats.append(start << 31 | (end - start) << 20 | (total[start] & 511) << 11 | np.minimum(upto, 63) << 5 | np.minimum(before, 31))
    return np.concatenate(rows), np.array(digests, np.uint64).view(np.int64), np.concatenate(ats)


def _around(start: np.ndarray, end: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far a passage whose shared chunks run from start to end may go: its first 16 bytes, and what it holds of
    the rolling hash's chunks at either end, may be cut otherwise."""
    lo = edges[np.maximum(0, np.searchsorted(edges, np.maximum(0, start - 16)) - 1)]
    return lo, edges[np.minimum(len(edges) - 1, np.searchsorted(edges, end, "right"))]


def unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end, the first word's number modulo 512, words from the start to where a passage may end (63: or more), words before (31: or more)."""
    start = at >> 31
    return start, start + (at >> 20 & 0x7FF), at >> 11 & 0x1FF, at >> 5 & 0x3F, at & 0x1F


#: Bytes of a unit, and of the runs on one alignment that the first step extends; the second step finds what is in others.
UNIT, LEAST_BYTES = 32, 48


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Equal items at the beginning, in growing steps."""
    n, at, step = min(len(x), len(y)), 0, 256
    while at < n:
        d = np.flatnonzero(x[at : at + step][: n - at] != y[at : at + step][: n - at])
        if len(d):
            return at + int(d[0])
        at, step = at + step, step * 4
    return n


def stretches(a: bytes, b: bytes, anchors: list[tuple[int, int]], min_words: int, a_cut: tuple[bool, bool] = (False, False), b_cut: tuple[bool, bool] = (False, False)) -> list[tuple[int, int, int, int]]:
    """(start in a, end in a, words, start in b) of the longest common stretches around the anchors (places in a and b).

    a_cut, b_cut: whether the text goes on before and after what is given; then its
    first and last byte only show where words begin and end.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x_lo, x_hi, y_lo, y_hi = int(a_cut[0]), len(a) - a_cut[1], int(b_cut[0]), len(b) - b_cut[1]
    out, done = [], {}
    for s, o in sorted(anchors):
        if s < done.get(s - o, 0):
            continue  # within a stretch on the same alignment
        left, right = _common(x[x_lo:s][::-1], y[y_lo:o][::-1]), _common(x[s:x_hi], y[o:y_hi])
        done[s - o] = s + right
        first, end = s - left, s + right
        n = len(a[first:end].split())
        if n and first and not _SPACE[a[first]] and not _SPACE[a[first - 1]]:
            n -= 1  # begins within a word
        if n and end < len(a) and not _SPACE[a[end - 1]] and not _SPACE[a[end]]:
            n -= 1
        if n >= min_words:
            out.append((first, end, n, o - left))
    return out


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end."""
    space = np.r_[True, _SPACE[np.frombuffer(raw, np.uint8)], True]
    return np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1


def window_keys(raw: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and starts of all windows of min_words words: a polynomial in the bytes, from sums over all before them."""
    first, last = word_places(raw)
    n = len(first) - min_words + 1
    if n <= 0:
        return np.empty(0, np.int64), first[:0]
    s, e = first[:n], last[min_words - 1 :]
    return spans_hashed(raw, s, e).view(np.int64), s


def first_windows(raw: bytes, min_words: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and word numbers of the windows with keys among the bits, but for those that overlap with an equal one before: in a text that repeats itself a window would match at every step."""
    keys, starts = window_keys(raw, min_words)
    some = np.flatnonzero(known(bits, keys))
    if not len(some):
        return keys[:0], starts[:0], some
    order = some[np.argsort(keys[some], kind="stable")]
    k, s, e = keys[order], starts[order], word_places(raw)[1][order + min_words - 1]
    again = np.r_[False, (k[1:] == k[:-1]) & (s[1:] < e[:-1])]
    keep = np.sort(order[~again])
    return keys[keep], starts[keep], keep


def open_windows(raw: bytes, runs: list[tuple[int, int]], found: list[tuple[int, int]], gear: np.ndarray, min_words: int) -> np.ndarray:
    """Keys of the windows that lie in the runs and what stands next to them, but not whole in a passage that is found."""
    lows, highs = _around(*np.array(runs, np.int64).T, np.r_[0, gear_ends(raw, gear)])
    keys, starts = window_keys(raw, min_words)
    ends = word_places(raw)[1][min_words - 1 :]
    keep = np.zeros(len(keys), bool)
    for lo, hi in zip(lows.tolist(), highs.tolist()):
        keep |= (starts >= lo) & (ends <= hi)
    for lo, hi in found:
        keep &= (starts < lo) | (ends > hi)
    return keys[keep]


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from that before it; there are no nulls."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _runs(batches, min_words: int):
    """Runs of shared chunks, from rows (id, at, o_id, o_start) sorted by id and place, whole documents or parts of them.

    With o_id: of LEAST_BYTES bytes at least on one alignment with another document.
    Without: of any shared chunks, if a passage of min_words may lie in them.
    """
    held: pa.Table | None = None

    def work(t: pa.Table, last: bool):
        """All runs but, unless it is the last call, those that the end of the rows may cut; and from where the rows stay."""
        start, end, number, upto, before = unpacked(t.column("at").combine_chunks().to_numpy())
        shift = start - t.column("o_start").combine_chunks().to_numpy()
        ids, other = t.column("id").combine_chunks(), t.column("o_id").combine_chunks()
        gap = np.r_[True, _changes(ids) | (start[1:] > end[:-1])]
        first = np.flatnonzero(gap)
        stay = len(gap) if last else int(first[-1])
        keep = first < stay
        first = first[keep]
        if not len(first):
            return None, stay
        stop = np.r_[first[1:], stay] - 1
        more = (upto[stop] == 63) | (before[first] == 31) | (start[stop] - start[first] >= 1024)  # then words may be any number
        fits = more | ((number[stop] - number[first] & 511) + upto[stop] + before[first] >= min_words)
        own = pc.equal(ids, other).to_numpy(zero_copy_only=False)
        step = gap | np.r_[True, _changes(other) | (shift[1:] != shift[:-1])]
        a = np.flatnonzero(step[:stay])
        z = np.r_[a[1:], stay] - 1
        good = (end[z] - start[a] >= LEAST_BYTES) & ~own[a]
        f, s, a, z = first[fits], stop[fits], a[good], z[good]
        none = pa.nulls(len(f), other.type)
        rows = pa.array(np.r_[a, f])
        cols = [ids.take(rows), pa.concat_arrays([other.take(pa.array(a)), none]), pa.array(np.r_[shift[a], np.zeros(len(f), np.int64)]), pa.array(np.r_[start[a], start[f]]), pa.array(np.r_[end[z], end[s]])]
        return pa.RecordBatch.from_arrays(cols, ["id", "o_id", "shift", "start", "end"]), stay

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        # Rows that repeat an id and a text give each chunk more than once.
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        at = held.column("at").combine_chunks()
        new = np.r_[True, _changes(at) | _changes(held.column("id").combine_chunks())]
        held = held.filter(pa.array(new))
        out, stay = work(held, False)
        if out is not None:
            yield out
        held = held.slice(stay)
    if held is not None and held.num_rows:
        out, _ = work(held, True)
        if out is not None:
            yield out


def _plain(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """Documents (id, text) with ids that are not null and stand for one text each, and how the given ids come back."""
    kind = df.select(named(id_col)).schema[0].dataType.simpleString()
    docs = df.select(named(id_col).alias("id"), named(text_col).alias("text"))
    counts = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if counts.isEmpty():
        return docs, F.col
    key = F.concat(F.coalesce(F.concat(F.lit("v"), F.col("id").cast("string")), F.lit("n")), F.lit("/"), F.hex(F.xxhash64("text")))

    def back(column: str) -> Column:
        name = F.regexp_replace(F.col(column), "/[0-9A-F]+$", "")
        return F.when(name.startswith("v"), F.substring(name, 2, (1 << 31) - 1).cast(kind))

    return docs.select(key.alias("id"), "text"), back


def _compared(docs: DataFrame, runs: DataFrame, kind: str, min_words: int) -> DataFrame:
    """(id, first_byte, end_byte, n_words, other_id, other_byte): the stretches around runs (id, o_id, shift, start, end).

    Only the runs' bytes and SLACK more at either end leave their texts, once for all runs that ask for the same.
    """
    w = Window.partitionBy("id", "o_id", "shift").orderBy("start")
    near = F.coalesce(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= 2 * SLACK, F.lit(False))
    grouped = runs.withColumn("g", F.sum(F.when(near, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = grouped.groupBy("id", "o_id", "shift", "g").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.collect_list("start").alias("anchors"))
    lo = lambda x: F.greatest(F.lit(0), x - SLACK)
    s, e, shift = F.col("s"), F.col("e"), F.col("shift")
    asked = cut(grouped.select("id", "o_id", "shift", "anchors", lo(s).alias("lo"), (e + SLACK).alias("hi"), lo(s - shift).alias("o_lo"), (e - shift + SLACK).alias("o_hi")))
    want = asked.select("id", "lo", "hi").unionByName(asked.select(F.col("o_id").alias("id"), F.col("o_lo").alias("lo"), F.col("o_hi").alias("hi"))).distinct()
    want = want.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # as many as a text has runs
    texts = likely(docs, "id", want.select("id")).join(want, "id").select("id", "text", "spans")

    def take(batches):
        for b in sliced(batches, 1, rows=128):
            ids, rows = [], []
            for i, (text, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                raw = text.encode("utf-8", "surrogatepass")
                for x in spans:
                    ids.append(i)
                    rows.append((x["lo"], x["hi"], raw[x["lo"] : x["hi"]], x["hi"] < len(raw)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "lo", "hi", "raw", "more"])

    pieces = texts.mapInArrow(take, f"id {kind}, lo long, hi long, raw binary, more boolean")
    mine = pieces.select("id", "lo", "hi", F.col("raw").alias("a"), F.col("more").alias("a_more"))
    theirs = pieces.select(F.col("id").alias("o_id"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("raw").alias("b"), F.col("more").alias("b_more"))
    both = asked.join(mine, ["id", "lo", "hi"]).join(theirs, ["o_id", "o_lo", "o_hi"]).select("id", "o_id", "shift", "anchors", "lo", "o_lo", "a", "a_more", "b", "b_more")

    def compare(batches):
        for batch in sliced(batches, 6, 8):
            keep, rows = [], []
            for i, (shift, anchors, lo, o_lo, a, a_more, b, b_more) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                got = stretches(a, b, [(x - lo, x - shift - o_lo) for x in anchors], min_words, (lo > 0, a_more), (o_lo > 0, b_more))
                keep += [i] * len(got)
                rows += [(lo + first, lo + end, n, o_lo + there) for first, end, n, there in got]
            at, cols = pa.array(keep, pa.int64()), list(zip(*rows)) if rows else [[]] * 4
            first, end, n, there = (pa.array(c, pa.int64()) for c in cols)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), first, end, n, batch.column(1).take(at), there], ["id", "first_byte", "end_byte", "n_words", "other_id", "other_byte"])

    return cut(both.mapInArrow(compare, f"id {kind}, first_byte long, end_byte long, n_words long, other_id {kind}, other_byte long").distinct())


def _with_originals(out: DataFrame) -> DataFrame:
    """out and, for each passage, a row of the other document, with the smallest of those that repeat it."""
    there = (F.col("other_byte") + F.col("end_byte") - F.col("first_byte")).alias("end_byte")
    back = out.select(F.col("other_id").alias("id"), F.col("other_byte").alias("first_byte"), there, "n_words", F.struct(F.col("id").alias("o"), "first_byte").alias("by"))
    back = back.groupBy("id", "first_byte", "end_byte", "n_words").agg(F.min("by").alias("by"))
    return out.unionByName(back.select("id", "first_byte", "end_byte", "n_words", F.col("by.o").alias("other_id"), F.col("by.first_byte").alias("other_byte")))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, first_byte, end_byte, n_words, other_id, other_byte): passages of min_words or more that another document holds too.

    other_id is the first document that holds the passage's chunks or a window of its
    words; the passage is reported there as well, with the smallest of the others.
    """
    bound_batches(df.sparkSession)
    docs, back = _plain(df, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches, shared=None):
        gear = gear_table()
        for b in sliced(batches, 1):
            row, digest, at = chunk_batch(b.column(1).to_pylist(), gear)
            if shared is not None:
                some = known(shared.value, digest)
                row, digest, at = row[some], digest[some], at[some]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(digest), pa.array(at)], ["id", "digest", "at"])

    chunks = docs.mapInArrow(run, f"id {kind}, digest long, at long")
    # Chunks of very many documents are pre-aggregated; what comes back is one row a digest that two documents hold.
    first = F.min(F.struct("id", "at")).alias("f")
    twice = chunks.groupBy("digest").agg(first, F.max("id").alias("l")).where("f.id <> l")
    twice = cut(twice.select("digest", F.col("f.id").alias("o_id"), F.shiftright("f.at", 31).alias("o_start")))
    # Kept apart, so that a digest of very many chunks is split by the skew join.
    bits = Bitmap(twice.select("digest"), hashed=True).shared
    held = docs.mapInArrow(lambda batches: run(batches, bits), chunks.schema).join(twice, "digest").select("id", "at", "o_id", "o_start")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(n, "id").sortWithinPartitions("id", "at")
    runs = cut(held.mapInArrow(lambda batches: _runs(batches, min_words), f"id {kind}, o_id {kind}, shift long, start long, end long"))
    out = _compared(docs, runs.where("o_id is not null"), kind, min_words)

    # Second step: what may hold a passage and has none yet.
    free = runs.where("o_id is null").groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    done = _with_originals(out).select("id", F.struct(F.col("first_byte").alias("start"), F.col("end_byte").alias("end")).alias("x")).distinct().groupBy("id").agg(F.collect_list("x").alias("found"))

    def still_open(batches):
        for b in sliced(batches, rows=4096):
            keep = []
            for runs, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = [(x["start"], x["end"]) for x in found or ()]
                keep.append([r for r in runs if not any(lo <= r["start"] and r["end"] <= hi for lo, hi in spans)])
            some = pa.array([bool(k) for k in keep], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(some), pa.array([k for k in keep if k], b.column(1).type), b.column(2).filter(some)], ["id", "runs", "found"])

    spans = "array<struct<start: bigint, end: bigint>>"
    left = cut(free.join(done, "id", "left").select("id", "runs", "found").mapInArrow(still_open, f"id {kind}, runs {spans}, found {spans}"))
    if not left.isEmpty():

        def keyed(batches):
            gear = gear_table()
            for b in sliced(batches, 0):
                keys = [np.empty(0, np.int64)]
                for text, runs, found in zip(*(c.to_pylist() for c in b.columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    keys.append(open_windows(raw, [(r["start"], r["end"]) for r in runs], [(r["start"], r["end"]) for r in found or ()], gear, min_words))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)))], ["key"])

        def search(batches):
            for b in sliced(batches, 1):
                got = [first_windows((t or "").encode("utf-8", "surrogatepass"), min_words, bits.value) for t in b.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(got)), [len(k) for k, *_ in got]))
                keys, starts, places = (np.concatenate(c).astype(np.int64) for c in zip(*got))
                # Windows that begin within min_words words of each other on one alignment are of one passage.
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *map(pa.array, (keys, starts, places // min_words))], ["id", "key", "start", "part"])

        texts = likely(docs, "id", left.select("id")).join(left, "id").select("text", "runs", "found")
        wanted = cut(texts.mapInArrow(keyed, "key long").distinct())
        bits = Bitmap(wanted, hashed=True, size=16 * wanted.count()).shared
        windows = docs.mapInArrow(search, f"id {kind}, key long, start long, part long")
        windows = cut(windows.join(wanted, "key", "left_semi"))
        again = windows.groupBy("key").agg(F.min(F.struct("id", "start")).alias("f"), F.max("id").alias("l")).where("f.id <> l")
        again = again.select("key", F.col("f.id").alias("o_id"), F.col("f.start").alias("o_start"))
        same = windows.join(again, "key").where("id <> o_id").groupBy("id", "o_id", (F.col("start") - F.col("o_start")).alias("shift"), "part")
        out = out.unionByName(_compared(docs, same.agg(F.min("start").alias("start"), (F.max("start") + 1).alias("end")), kind, min_words)).distinct()
    out = _with_originals(out)
    return out.select(back("id").alias("id"), "first_byte", "end_byte", "n_words", back("other_id").alias("other_id"), "other_byte")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """The rows of df with repeated runs cut out of the text but for their first occurrence; ids must be unique."""
    spans = repeats(df, id_col, text_col, min_words).where("other_id < id")
    spans = spans.groupBy(F.col("id").alias("_span_id")).agg(F.array_sort(F.collect_list(F.struct("first_byte", "end_byte"))).alias("_spans"))
    row = df.select(F.struct(*[named(c) for c in df.columns]).alias("_row"), named(id_col).alias("_id"), named(text_col).alias("_text"))
    joined = row.join(spans, F.col("_id").eqNullSafe(F.col("_span_id")), "left")

    @F.pandas_udf("string")
    def without(texts, spans):
        out = []
        for t, s in zip(texts, spans):
            if s is None or t is None:
                out.append(t)
                continue
            b, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for x in s:
                parts.append(b[at : max(at, x["first_byte"])])
                at = max(at, x["end_byte"])
            out.append((b"".join(parts) + b[at:]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    kept = joined.withColumn("_text", without("_text", "_spans"))
    return kept.select(*[(F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in df.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' passages that occur elsewhere too, by document and place."""
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "first_byte", "end_byte", "n_words", "other_id", "other_byte")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {}
