"""Token ids packed into rows of a fixed length by best-fit-decreasing.

Texts are encoded with a public tokenizer whose file is a parameter. Documents
longer than a row are cut into whole rows and a rest; nothing is lost. A task
packs its documents in groups of a bounded number of tokens: pieces by falling
length, each into the row with the least room that still holds it, which a
segment tree over the room left finds in logarithmic time. Nothing is shuffled.

A packed row has its ids as little-endian binary (two bytes an id if the
vocabulary allows), padded to the row's length; the cumulative segment lengths;
the places where positions start again from 0; and each segment's document and
part, from which `unpack` restores all documents.

Rows and their pack_ids follow from how Spark splits the input, so they are the same
for the same files read in the same way, and unique always; the segments are the
same however it is split.

Defined results: null and empty texts have no tokens and no segment. Null ids
are kept as null. Repeated rows are each packed. An empty table gives no rows.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, named, sliced, table
from ._files import Staged

#: The split pattern that goes with the vocabulary files of byte-level BPE (a fixed value of theirs).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW = 4096
GROUP_TOKENS = 1 << 23


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Rooms:
    """A segment tree over the room left in open rows; finds the least room of at least a size."""

    def __init__(self, most: int) -> None:
        self.n = 1
        while self.n <= most:
            self.n *= 2
        self.count = [0] * (2 * self.n)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row that holds size more, removed; None if there is none."""
        i, count = size + self.n, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.n
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Which pieces (none over length) make each row, by best-fit-decreasing; ties in the given order."""
    rows: list[list[int]] = []
    rooms = Rooms(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        rows[found[1]].append(i)
        if found[0] > sizes[i]:
            rooms.add(found[0] - sizes[i], found[1])
    return rows


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = ROW, path: str = VOCABULARY, pad_id: int = 0) -> DataFrame:
    """(pack_id, n_tokens, input_ids, cu_seqlens, position_resets, doc_ids, parts): one row a packed row of `length` ids."""
    spark = df.sparkSession
    bound_batches(spark)
    raw = vocabulary(path)
    kind = df.select(named(id_col)).schema[0].dataType.simpleString()
    docs = df.select(named(id_col).alias("id"), named(text_col).alias("text"))

    def run(batches):
        enc = encoder(raw)
        dtype = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        base = TaskContext.get().partitionId() << 36
        ids, parts, pieces, held, made = [], [], [], 0, 0
        id_type = None

        def flush():
            nonlocal ids, parts, pieces, held, made
            rows = best_fit([len(p) for p in pieces], length)
            for s in range(0, len(rows), 256):
                some = rows[s : s + 256]
                out = np.full((len(some), length), pad_id, dtype)
                cu = []
                for k, row in enumerate(some):
                    ends = [0]
                    for i in row:
                        out[k, ends[-1] : ends[-1] + len(pieces[i])] = pieces[i]
                        ends.append(ends[-1] + len(pieces[i]))
                    cu.append(ends)
                cols = [
                    pa.array(range(base + made, base + made + len(some)), pa.int64()),
                    pa.array([c[-1] for c in cu], pa.int32()),
                    pa.array([x.tobytes() for x in out], pa.binary()),
                    pa.array(cu, pa.list_(pa.int32())),
                    pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
                    pa.array([[ids[i] for i in row] for row in some], pa.list_(id_type)),
                    pa.array([[parts[i] for i in row] for row in some], pa.list_(pa.int32())),
                ]
                made += len(some)
                yield pa.RecordBatch.from_arrays(cols, ["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "parts"])
            ids, parts, pieces, held = [], [], [], 0

        for b in sliced(batches, 1):
            id_type = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                tokens = enc.encode_to_numpy(text, disallowed_special=()).astype(dtype)
                for part, at in enumerate(range(0, len(tokens), length)):
                    ids.append(key)
                    parts.append(part)
                    pieces.append(tokens[at : at + length])
                held += len(tokens)
                if held >= GROUP_TOKENS:
                    yield from flush()
        if pieces:
            yield from flush()

    return docs.mapInArrow(run, f"pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, parts array<int>")


def write_matrices(packed: DataFrame, folder: str, length: int = ROW, rows: int = 4096, item: int = 2) -> str:
    """Write packed rows as .npy: id matrices, position matrices, cumulative lengths and their offsets. Returns the manifest's path.

    Each task writes files of at most `rows` rows under temporary names and renames
    them. The manifest (name, rows, files, sha256 of the id matrix), committed with
    _SUCCESS, lists what counts; files of lost tasks do not.
    """
    dtype = np.uint16 if item == 2 else np.uint32

    def npy(x: np.ndarray) -> bytes:
        f = io.BytesIO()
        np.save(f, x)
        return f.getvalue()

    def run(batches):
        context = TaskContext.get()
        attempt, held, n, done = str(context.taskAttemptId()), [], 0, []

        def flush():
            nonlocal held, n
            # Two attempts at a task may pack otherwise, so their files have names of their own.
            name = f"pack-{context.partitionId():05d}-{attempt}-{n:05d}"
            ids = np.stack([np.frombuffer(r[0], dtype) for r in held])
            position = np.zeros((len(held), length), np.uint32)
            for k, (_, cu) in enumerate(held):
                for a, b in zip(cu, cu[1:]):
                    position[k, a:b] = np.arange(b - a)
            cu = [r[1] for r in held]
            raw = npy(ids)
            for kind, x in (("ids", raw), ("positions", npy(position)), ("cu_seqlens", npy(np.concatenate(cu))), ("cu_offsets", npy(np.cumsum([0] + [len(c) for c in cu])))):
                f = Staged(folder, f"{name}.{kind}.npy", attempt)
                f.write(x)
                f.commit()
            done.append((name, len(held), hashlib.sha256(raw).hexdigest()))
            held, n = [], n + 1

        for b in sliced(batches, 0):
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(r)
                if len(held) == rows:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["name", "rows", "sha256"])

    packed.select("input_ids", "cu_seqlens").mapInArrow(run, "name string, rows long, sha256 string").write.json(manifest := f"{folder}/_manifest")
    return manifest


def unpack(rows: list, raw: bytes, item: int = 2) -> dict:
    """Texts by document id from collected packed rows: the inverse of `pack` for unique ids."""
    enc, parts = encoder(raw), {}
    for r in rows:
        x = np.frombuffer(r["input_ids"], np.uint16 if item == 2 else np.uint32)
        for k, (doc, part) in enumerate(zip(r["doc_ids"], r["parts"])):
            parts.setdefault(doc, {})[part] = x[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    return {d: enc.decode(np.concatenate([p[i] for i in sorted(p)]).tolist()) for d, p in parts.items()}


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pack": op9_pack}
ORACLES: dict[str, str] = {}
