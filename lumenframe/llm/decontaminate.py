"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a span of words and ignore the others, so a
substituted word at an ignored position does not break a hit. The hashes of all
masked spans of the benchmark are joined with those of all documents; around
each hit the document and the item are compared word by word on that alignment,
and the longest stretch of which four of five words agree is an overlap if it has
`min_words` words or covers the item.

Words are compared lower-cased and without punctuation. The benchmark goes to the
executors in blocks of bounded size (BLOCK_WORDS, or one longer item), each against all
documents; documents are never shuffled. So a benchmark costs a pass over the documents
a block.

Defined results: null or empty texts and items without words overlap with
nothing. Items of fewer words than `min_words` count only as a whole, word for
word. Null ids are reported as null. Repeated rows are each reported. Empty
tables give no overlaps. Columns other than ids and texts pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, map_rows, named, sliced, table
from ._words import Hasher, finish

#: 1: the word counts, 0: it is ignored. Six of up to nine words, chosen by enumeration: every ten words of which
#: eight agree hold a hit, and so does every longer stretch of which four of five agree (the test enumerates them).
#: With `min_words` below ten some substitutions are not found.
MASKS = ("111111", "1111011", "11001111", "110101011", "110100111")
#: A block of the benchmark: at most so many words (or one longer item), about 50 MB of keys.
BLOCK_WORDS = 400_000
_BITS = 22


def _spans(mask: str, n: int) -> tuple[np.ndarray, int]:
    used = np.flatnonzero(np.array(list(mask)) == "1")
    return used, max(0, n - len(mask) + 1)


def _keys(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """One key for each position at which the mask fits."""
    used, n = _spans(mask, len(h))
    out = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in used:
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return finish(out)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the longest stretch of which four of five words match, from a match to a match."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total, "left")  # the first place that is no higher than this one
    end = int((np.arange(len(total)) - first).argmax())
    start = int(first[end])
    hit = np.flatnonzero(same[start:end])
    return (start + int(hit[0]), start + int(hit[-1]) + 1, len(hit)) if len(hit) else (0, 0, 0)


def _back(keys: np.ndarray, pos: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many words before each place its key was last in the same text; 0 if it was not. Places rise."""
    order = np.lexsort((pos, keys, text))
    again = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(keys), np.int64)
    out[order[1:]] = np.where(again, np.diff(pos[order]), 0)
    return out


#: Hits that are looked at together.
HITS = 1 << 18


class Index:
    """The seeds of one block of the benchmark, all in `arrays`, which are what workers get."""

    def __init__(self, items: list, texts: list, min_words: int) -> None:
        h, at = Hasher().many(texts)
        keys, where = [], []
        for m, mask in enumerate(MASKS):
            k = _keys(h, mask, m)
            pos = np.arange(len(k))
            item = np.searchsorted(at, pos, "right") - 1
            inside = pos + len(mask) <= at[item + 1]
            keys.append(k[inside])
            where.append(pos[inside])
        # Items shorter than the shortest mask: their first word, then all of them.
        short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < len(MASKS[0])))
        keys.append(h[at[short]])
        where.append(at[short])
        a = {"ids": items, "min_words": min_words, "h": h, "at": at}
        for m, (k, w) in enumerate(zip(keys, where)):
            back = _back(k, w, np.searchsorted(at, w, "right"))
            order = np.lexsort((back, k))
            same = np.searchsorted(k[order], k[order])  # where each key begins
            bits = np.zeros(1 << _BITS, bool)
            bits[k >> np.uint64(64 - _BITS)] = True
            a |= {f"keys{m}": k[order], f"where{m}": w[order].astype(np.int64), f"steps{m}": same << 32 | back[order], f"filter{m}": np.packbits(bits, bitorder="little")}
        self._use(a)

    def _use(self, arrays: dict) -> None:
        self.arrays, self.ids, self.min_words, self.h, self.at = arrays, arrays["ids"], arrays["min_words"], arrays["h"], arrays["at"]

    @classmethod
    def of(cls, arrays: dict) -> Index:
        self = cls.__new__(cls)
        self._use(arrays)
        return self

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in h, positions in the benchmark) with equal keys, HITS at a time.

        Where the last equal key is as far back in both, the pair of those two stands
        for the same alignment; so of a text that repeats itself only n + m of n * m
        pairs are made.
        """
        for m in range(len(MASKS) + 1):
            k = _keys(h, MASKS[m], m) if m < len(MASKS) else h
            keys, where, steps, bits = (self.arrays[f"{x}{m}"] for x in ("keys", "where", "steps", "filter"))
            if not len(keys) or not len(k):
                continue
            top = (k >> np.uint64(64 - _BITS)).astype(np.int64)
            pos = np.flatnonzero((bits[top >> 3] >> (top & 7).astype(np.uint8)) & 1)
            lo, hi = (np.searchsorted(keys, k[pos], side) for side in ("left", "right"))
            pos, lo, hi = pos[hi > lo], lo[hi > lo], hi[hi > lo]
            back = _back(k[pos], pos, np.searchsorted(at, pos, "right"))
            a, z = (np.searchsorted(steps, lo << 32 | back, side) for side in ("left", "right"))
            a, z = np.where(back, a, hi), np.where(back, z, hi)  # a first one has nothing before it
            pos, lo, n = np.r_[pos, pos], np.r_[lo, z], np.r_[a - lo, hi - z]
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            ends = np.cumsum(n)
            for s in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                t = np.arange(s, min(s + HITS, int(ends[-1])))
                i = np.searchsorted(ends, t, "right")
                yield pos[i], where[lo[i] + t - (ends[i] - n[i])]

    def overlaps(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end word, matching words): of each row and item the overlap with most matching words, then the first."""
        span, items = len(h) + len(self.h) + 1, len(self.at)
        found = [np.empty(0, np.int64)]  # each alignment of a row and an item once
        for pos, ref in self.hits(h, at):
            row = np.searchsorted(at, pos, "right") - 1
            item = np.searchsorted(self.at, ref, "right") - 1
            found.append(np.unique((row * items + item) * span + pos - ref + len(self.h)))
            if sum(map(len, found)) > 4 * HITS:
                found = [np.unique(np.concatenate(found))]
        code = np.unique(np.concatenate(found))
        shift, pair = code % span - len(self.h), code // span
        row, item = pair // items, pair % items
        lo, hi = np.maximum(self.at[item], at[row] - shift), np.minimum(self.at[item + 1], at[row + 1] - shift)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # Longest alignments first: those too short to hold more matches are passed over.
        order = np.lexsort((shift, lo - hi, pair))
        for r, i, s, lo, hi in zip(*(x[order].tolist() for x in (row, item, shift, lo, hi))):
            most = best.get((r, i), (0, 0, 0))
            if hi - lo < most[0]:
                continue
            size = int(self.at[i + 1] - self.at[i])
            a, b, match = best_stretch(self.h[lo:hi] == h[lo + s : hi + s])
            if match == b - a == size or (b - a >= self.min_words and size >= self.min_words):
                here = (match, -int(lo + s + a - at[r]), -int(lo + s + b - at[r]))
                best[r, i] = max(most, here) if most[0] else here
        return [(r, i, -a, -b, match) for (r, i), (match, a, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, min_words: int) -> Iterator[Index]:
    """Indexes of the benchmark in blocks; one partition of it is on the driver at a time."""
    ids, texts, words = [], [], 0
    for item, text in benchmark.select(named(id_col), named(text_col)).toLocalIterator():
        n = len((text or "").split())
        if ids and words + n > BLOCK_WORDS:
            yield Index(ids, texts, min_words)
            ids, texts, words = [], [], 0
        ids.append(item)
        texts.append(text)
        words += n
    if ids:
        yield Index(ids, texts, min_words)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 10) -> DataFrame:
    """(id, item, first_word, end_word, n_match) for each document and item that overlap; the best overlap of the two."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.select(named(id_col)).schema[0].dataType.simpleString()
    other = benchmark.select(named(item_col)).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(other)
    out = None
    for index in blocks(benchmark, item_col, item_text, min_words):
        shared = spark.sparkContext.broadcast(index.arrays)

        def run(batches, shared=shared):
            hasher, index = Hasher(), Index.of(shared.value)
            for b in sliced(batches, 1):
                found = index.overlaps(*hasher.many(b.column(1).to_pylist()))
                cols = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.ids[i] for i in cols[1]], item_type), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    ["id", "item", "first_word", "end_word", "n_match"],
                )

        part = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, item {other.simpleString()}, first_word long, end_word long, n_match long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"id {kind}, item {other.simpleString()}, first_word long, end_word long, n_match long")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 10) -> DataFrame:
    """The rows of docs, unchanged, that overlap with no item of the benchmark."""
    bound_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    for index in blocks(benchmark, item_col, item_text, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(index.arrays)

        def run(batches, shared=shared):
            hasher, index = Hasher(), Index.of(shared.value)
            for b in sliced(batches, place):
                bad = {x[0] for x in index.overlaps(*hasher.many(b.column(place).to_pylist()))}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = map_rows(docs, run)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with the items it overlaps."""
    out = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "end_word", "n_match")


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
