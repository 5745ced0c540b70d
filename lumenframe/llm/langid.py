"""Language ID with a byte convolutional network trained in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
window and classified by softmax. A text is cut into consecutive windows of a
fixed length that cover all of it; its prediction is the mean of the windows'
probabilities, weighted by their lengths. The network is fitted on a bounded
sample of labelled rows (`per_label` rows of a label, `windows` windows a row).

Defined results: a null text, one without a letter, or a model without classes
gives `und` with score 0. Scores have six digits, which do not depend on what else
is in a batch. With one class that class has score 1. Null labels are
not learned from. Repeated rows get equal predictions; ties go to the label that
is first by code point. An empty table gives an empty one. Columns other than
the named ones are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, map_rows, named, sliced, table

UND = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """Multi-width byte convolutions, max pooling, softmax."""

    labels: list
    window: int = 256
    stride: int = 2
    widths: tuple = (2, 3, 4)
    filters: int = 16
    dim: int = 8

    def start(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        tall, n = max(self.widths), len(self.widths) * self.filters
        self.mask = np.zeros((tall, self.dim, n), np.float32)
        for i, w in enumerate(self.widths):
            self.mask[:w, :, i * self.filters : (i + 1) * self.filters] = 1
        self.mask = self.mask.reshape(tall * self.dim, n)
        self.p = {
            "emb": r.normal(0, 0.5, (256, self.dim)).astype(np.float32),
            "conv": (r.normal(0, 0.3, (tall * self.dim, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": r.normal(0, 0.1, (n, len(self.labels))).astype(np.float32),
            "off": np.zeros(len(self.labels), np.float32),
        }

    def _pool(self, x: np.ndarray):
        """x: (rows, window) bytes. Pooled features, where each maximum is, and the convolved patches."""
        tall = max(self.widths)
        e = self.p["emb"][x].reshape(len(x), -1)
        at = (x.shape[1] - tall) // self.stride + 1
        step = self.stride * self.dim * 4
        v = np.lib.stride_tricks.as_strided(e, (len(x), at, tall * self.dim), (e.strides[0], step, 4))
        y = np.ascontiguousarray(v).reshape(-1, tall * self.dim) @ self.p["conv"]
        y = y.reshape(len(x), at, -1)
        return y, v

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for s in range(0, len(x), 256):
            y, _ = self._pool(x[s : s + 256])
            h = np.maximum(y.max(axis=1) + self.p["bias"], 0)
            z = h @ self.p["out"] + self.p["off"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7, least_steps: int = 1000) -> None:
        """Adam on the cross-entropy, for least_steps steps at least; gradients flow to the embedding through the pooled positions alone."""
        self.start(seed)
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, tall = 0, max(self.widths)
        each = -(-len(x) // batch)
        epochs = max(epochs, -(-least_steps // max(1, each)))
        total = epochs * each
        for _ in range(epochs):
            order = r.permutation(len(x))
            for b in range(0, len(x), batch):
                i = order[b : b + batch]
                xb, n, t = x[i], len(i), t + 1
                c, v = self._pool(xb)
                top = c.argmax(axis=1)  # (n, filters)
                pre = np.take_along_axis(c, top[:, None, :], 1)[:, 0] + self.p["bias"]
                h = np.maximum(pre, 0)
                z = h @ self.p["out"] + self.p["off"]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(n), y[i]] -= 1
                d /= n
                g = {"out": h.T @ d, "off": d.sum(0)}
                dh = (d @ self.p["out"].T) * (pre > 0)
                g["bias"] = dh.sum(0)
                patch = v[np.arange(n)[:, None], top]  # (n, filters, tall * dim)
                g["conv"] = np.einsum("nf,nfk->kf", dh, patch) * self.mask
                back = (dh[:, :, None] * self.p["conv"].T[None]).reshape(n, -1, tall, self.dim)
                which = xb[np.arange(n)[:, None, None], top[:, :, None] * self.stride + np.arange(tall)]
                g["emb"] = np.zeros_like(self.p["emb"])
                np.add.at(g["emb"], which.reshape(-1), back.reshape(-1, self.dim))
                now = rate * (1 - 0.9 * t / total)
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    s[k] = 0.999 * s[k] + 0.001 * a * a
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def windows(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All consecutive windows of a text, the last padded with zeros; and their lengths."""
        w = self.window
        n = max(1, -(-len(raw) // w))
        x = np.zeros(n * w, np.uint8)
        x[: len(raw)] = np.frombuffer(raw, np.uint8)
        size = np.full(n, w, np.int64)
        size[-1] = len(raw) - (n - 1) * w
        return x.reshape(n, w), size

    def predict(self, texts: list) -> tuple[list, list]:
        """Label and score of each text; windows of many texts go through the network together."""
        out: list = [(UND, 0.0)] * len(texts)
        if not self.labels:
            return [a for a, _ in out], [b for _, b in out]
        xs, sizes, who, held = [], [], [], 0
        sums = np.zeros((len(texts), len(self.labels)))
        total = np.zeros(len(texts))

        def flush():
            nonlocal xs, sizes, who, held
            if xs:
                size = np.concatenate(sizes).astype(np.float64)
                rows = np.repeat(np.array(who), [len(a) for a in xs])
                p = self.probabilities(np.concatenate(xs)).astype(np.float64)
                np.add.at(sums, rows, p * size[:, None])
                np.add.at(total, rows, size)
            xs, sizes, who, held = [], [], [], 0

        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            x, size = self.windows(text.encode("utf-8", "surrogatepass"))
            for s in range(0, len(x), 4096):
                xs.append(x[s : s + 4096])
                sizes.append(size[s : s + 4096])
                who.append(i)
                held += len(xs[-1])
                if held >= 4096:
                    flush()
        flush()
        for i in np.flatnonzero(total):
            k = int(sums[i].argmax())
            out[i] = (self.labels[k], round(float(min(1.0, sums[i, k] / total[i])), 6))
        return [a for a, _ in out], [b for _, b in out]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 1500, all_labels: int = 60_000, windows: int = 4, seed: int = 7, **shape) -> ByteCNN:
    """Fit on labelled rows of every label and `windows` windows a row, chosen by hash.

    The sample has at most per_label rows of a label and about all_labels rows in
    all (but one of each label at least), so it does not grow with the input, and
    with the number of labels only beyond all_labels of them. Labels come sorted.
    """
    bound_batches(df.sparkSession)
    known = df.select(named(label_col).cast("string").alias("y"), named(id_col).alias("i"), named(text_col).alias("x")).where("y is not null and x is not null")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    model = ByteCNN(labels, **shape)
    if not labels:
        return model
    per_label = max(1, min(per_label, all_labels // len(labels)))
    # Twice as many as wanted and 20 more, of which the first per_label by hash stay.
    shares = df.sparkSession.createDataFrame([(k, min(1.0, (2 * per_label + 20) / counts[k])) for k in labels], "y string, share double")
    u = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30)
    part = known.withColumn("u", u).join(F.broadcast(shares), "y").where("u < share")  # a row a label, as many as the model has classes
    w, length = windows, model.window

    def pick(batches):
        for b in sliced(batches, 2):
            ys, us, raws = [], [], []
            for y, v, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not _LETTER.search(text):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                r = np.random.default_rng(zlib.crc32(raw))
                got = []
                for k in range(w):  # whole windows, and shorter ones as texts' ends are
                    n = length if k % 2 == 0 else int(r.integers(16, length + 1))
                    at = int(r.integers(0, max(1, len(raw) - n + 1)))
                    got.append(raw[at : at + n])
                ys.append(y)
                us.append(v)
                raws.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.string()), pa.array(us, pa.float64()), pa.array(raws, pa.list_(pa.binary()))], ["y", "u", "raw"])

    got = part.select("y", "u", "x").mapInArrow(pick, "y string, u double, raw array<binary>")
    got = got.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("u", "raw"))).where(F.col("k") <= per_label)
    rows = got.select("y", "raw").orderBy("y", "k").collect()
    place = {y: k for k, y in enumerate(labels)}
    pairs = [(place[y], bytes(raw)) for y, many in rows for raw in many]
    x = np.zeros((len(pairs), length), np.uint8)
    for k, (_, raw) in enumerate(pairs):
        x[k, : len(raw)] = np.frombuffer(raw, np.uint8)
    model.fit(x, np.array([p[0] for p in pairs]), seed=seed)
    return model


def predict(df: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; the id and the text are all that is read."""
    bound_batches(df.sparkSession)
    kind = df.select(named(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, 1):
            lang, score = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: ByteCNN, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of df, unchanged, whose language the model names with a score of `least` or more."""
    bound_batches(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches):
        for b in sliced(batches, place):
            lang, score = model.predict(b.column(place).to_pylist())
            yield b.filter(pa.array([a != UND and s >= least for a, s in zip(lang, score)], pa.bool_()))

    return map_rows(df, run)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_langid": op1_langid}
ORACLES: dict[str, str] = {}
