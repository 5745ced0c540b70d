"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample (exact) is cut into balanced parts; a small
network learns which part a vector belongs to. Every vector is indexed in its most
probable part. A query goes to its several most probable parts, whose vectors are
ranked by the exact cosine. How many parts is set on held-out sample queries so
that `wanted` of their neighbours are found; a query whose parts hold fewer than k
other vectors goes to all parts.

Sizes: the number of parts grows with the square root of the number of vectors, from
32 to 1,024; the sample has 64 vectors a part, 8,192 at least and 65,536 at most, and
no more than `sample_floats` numbers (so 2,730 vectors of 1,536 dimensions; the number
of parts falls with it).

Hot parts are split: a part of more than `chunk` vectors into salted groups, its
queries likewise; one group holds at most about `chunk` vectors and `block`
queries. Queries and vectors never meet on the driver.

Defined results: ids are whole numbers. Vectors that are null, zero, hold null or
non-finite components or have another length than most, and rows with a null id, take
no part. Rows are told apart by themselves, not by their ids: a row that repeats an id
is a candidate like any other and a query of its own, with a list of its own. With
fewer than k candidates all are returned. Repeated vectors tie, and smaller ids come
first. An empty table gives an empty one. Columns other than id and vector are not
looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, cut, named, sliced, table

SAMPLE_FLOATS = 1 << 22


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each row's k nearest other rows by cosine; x has unit rows."""
    k, out, x = min(k, len(x) - 1), [], x.astype(np.float32)
    for s in range(0, len(x), 256):
        sim = x[s : s + 256] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        out.append(np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(sim), 0), int))
    return np.concatenate(out)


def balanced_partition(graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 8, seed: int = 3) -> np.ndarray:
    """Parts of at most slack * n / parts nodes that keep neighbours together.

    Nodes are placed breadth first, each where most of its placed neighbours are,
    weighed by the room left; then moved, while there is room, to the part where
    most neighbours are.
    """
    n = len(graph)
    near: list[list[int]] = [list(g) for g in graph]
    for i, g in enumerate(graph.tolist()):
        for j in g:
            near[j].append(i)
    room = math.ceil(slack * n / parts)
    part, size = np.full(n, -1), np.zeros(parts, int)
    order, seen = [], np.zeros(n, bool)
    for root in np.random.default_rng(seed).permutation(n).tolist():
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        for i in queue:
            for j in near[i]:
                if not seen[j]:
                    seen[j] = True
                    queue.append(j)
        order += queue
    for i in order:
        votes = np.bincount([part[j] for j in near[i] if part[j] >= 0], minlength=parts)
        score = (votes + 0.1) * (1 - size / room)
        part[i] = int(score.argmax())
        size[part[i]] += 1
    for _ in range(sweeps):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[near[i]], minlength=parts) if near[i] else np.zeros(parts)
            votes = np.where(size < room, votes, -1)
            best, now = int(votes.argmax()), part[i]
            if best != now and votes[best] > np.count_nonzero(part[near[i]] == now):
                size[now] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """A network with one hidden layer from unit vectors to parts."""

    def fit(self, x: np.ndarray, y: np.ndarray, parts: int, hidden: int = 128, epochs: int = 20, rate: float = 3e-3, seed: int = 5) -> Router:
        r = np.random.default_rng(seed)
        d = x.shape[1]
        p = {"a": r.normal(0, 1 / math.sqrt(d), (d, hidden)) * 2, "b": np.zeros(hidden), "c": r.normal(0, 1 / math.sqrt(hidden), (hidden, parts)), "e": np.zeros(parts)}
        m, s, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 256):
                b, t = order[i : i + 256], t + 1
                h = np.tanh(x[b] @ p["a"] + p["b"])
                z = h @ p["c"] + p["e"]
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[np.arange(len(b)), y[b]] -= 1
                g /= len(b)
                dh = (g @ p["c"].T) * (1 - h * h)
                for k, v in {"c": h.T @ g, "e": g.sum(0), "a": x[b].T @ dh, "b": dh.sum(0)}.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        return self

    def rank(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first."""
        z = np.tanh(x @ self.p["a"] + self.p["b"]) @ self.p["c"] + self.p["e"]
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def train(x: np.ndarray, parts: int, k: int = 5, wanted: float = 0.97, neighbours: int = 10, seed: int = 9) -> tuple[Router, int]:
    """The router, and the number of parts a query must try."""
    held = np.random.default_rng(seed).permutation(len(x))[: min(512, len(x) // 4)]
    y = balanced_partition(neighbour_graph(x, neighbours), parts)
    router = Router().fit(x, y, parts)
    if parts == 1 or not len(held):
        return router, parts
    # Held out: the router has not seen these when the number of parts is set.
    rest = np.setdiff1d(np.arange(len(x)), held)
    trial = Router().fit(x[rest], y[rest], parts)
    at = trial.rank(x, 1)[:, 0]
    true = []
    for s in range(0, len(held), 128):
        sim = x[held[s : s + 128]] @ x.T
        sim[np.arange(len(sim)), held[s : s + 128]] = -2
        true.append(np.argpartition(-sim, k, axis=1)[:, :k])
    true = np.concatenate(true)
    place = np.argsort(trial.rank(x[held], parts), axis=1)  # place of each part in a query's order
    need = place[np.arange(len(held))[:, None], at[true]]
    for n in range(1, parts + 1):
        if (need < n).mean() >= wanted:
            return router, n
    return router, parts


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec array<double>) of the rows that take part, and how many there are."""
    v = df.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.where(fine)
    usual = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("vec") == (usual["d"] if usual else 0)), usual["count"] if usual else 0


def _matrix(binary) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in binary]) if len(binary) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # very large and very small components keep their direction
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of one vector with the rows of x; equal rows give equal numbers."""
    s, t = np.abs(q).max(), np.abs(x).max(axis=1)
    q, x = q / s, x / t[:, None]
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def top(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k nearest of x but its own row, by exact cosine, ties to smaller ids."""
    out, unit, units = [], _unit(x), _unit(q)
    for s in range(0, len(q), 256):
        sim = units[s : s + 256] @ unit.T
        sim[q_rows[s : s + 256, None] == rows[None]] = -2
        edge = -np.partition(-sim, k - 1, axis=1)[:, k - 1] if sim.shape[1] >= k else np.full(len(sim), -2.0)
        for j in range(len(sim)):
            c = np.flatnonzero((sim[j] >= edge[j] - 1e-9) & (sim[j] > -1.5))
            score = cosine(q[s + j], x[c])
            best = np.lexsort((rows[c], ids[c], -score))[:k]
            out.append(pd.DataFrame({"query_row": q_rows[s + j], "query_id": q_ids[s + j], "row": rows[c[best]], "vec_id": ids[c[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []})


def search(df: DataFrame, queries, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, sample: int | None = None, parts: int | None = None, wanted: float = 0.97, chunk: int = 20_000, block: int = 2_000, sample_floats: int = SAMPLE_FLOATS) -> DataFrame:
    """(query_id, rank, vec_id, score); queries: a Column over `id` that says which rows are queries."""
    spark = df.sparkSession
    bound_batches(spark)
    vectors, n = usable(df, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    parts = parts or min(1024, max(32, round(math.sqrt(n) / 7)))
    sample = sample or min(1 << 16, max(8192, 64 * parts))
    dims = len(vectors.first()["vec"])
    sample = min(sample, max(256, sample_floats // dims))
    got = vectors.withColumn("h", F.xxhash64("id", F.lit(11))).orderBy("h", "id", "vec").limit(sample).select("vec").toArrow()
    x = _unit(got.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dims))
    parts = max(1, min(parts, len(x) // 64))
    router, probes = train(x, parts, k, wanted)

    def index(batches):
        for b in sliced(batches, rows=4096):
            v = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, dims))
            ranked = router.rank(_unit(v), probes) if b.num_rows else np.zeros((0, probes), int)
            raw = [r.tobytes() for r in np.ascontiguousarray(v)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(ranked.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["row", "id", "vec", "parts"])

    # The rows' numbers are written with them, so they are the same in all that follows.
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "id", "vec")
    indexed = cut(numbered.mapInArrow(index, "row long, id long, vec binary, parts array<int>"))
    base = indexed.select("row", "id", "vec", F.col("parts")[0].alias("part"))
    # The counts of the parts, a row a part, say how each is split and which queries need more parts.
    n_base = {r[0]: r[1] for r in base.groupBy("part").count().collect()}
    sizes = F.create_map(*[F.lit(v) for p in range(parts) for v in (p, n_base.get(p, 0))])
    within = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + sizes[p].cast("long"))
    tried = F.when(within > k, F.col("parts")).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = indexed.where(queries).select("row", "id", "vec", F.explode(tried).alias("part"))
    n_ask = {r[0]: r[1] for r in asked.groupBy("part").count().collect()}
    both = F.create_map(*[F.lit(v) for p in range(parts) for v in (p, -(-n_base.get(p, 1) // chunk))])
    other = F.create_map(*[F.lit(v) for p in range(parts) for v in (p, -(-n_ask.get(p, 1) // block))])
    steps = lambda m: F.explode(F.sequence(F.lit(0), m[F.col("part")] - 1))
    own = lambda m, seed: F.pmod(F.xxhash64("row", F.lit(seed)), m[F.col("part")]).cast("int")
    base = base.withColumn("b", own(both, 1)).withColumn("q", steps(other))
    asked = asked.withColumn("q", own(other, 2)).withColumn("b", steps(both))
    longs = ["query_row", "query_id", "row", "vec_id"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({**{c: np.empty(0, np.int64) for c in longs}, "score": np.empty(0)})
        found = top(left["row"].to_numpy(), left["id"].to_numpy(), _matrix(left["vec"]), right["row"].to_numpy(), right["id"].to_numpy(), _matrix(right["vec"]), k)
        return found.astype(dict.fromkeys(longs, np.int64))

    near = base.groupBy("part", "b", "q").cogroup(asked.groupBy("part", "b", "q")).applyInPandas(meet, "query_row long, query_id long, row long, vec_id long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op4_ann": op4_ann}
ORACLES: dict[str, str] = {}
