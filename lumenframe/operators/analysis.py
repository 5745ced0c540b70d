"""Comparison, focus, motion and alignment of images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import small_table, sorted_join

C1, C2 = 6.5025, 58.5225  # (0.01 * 255)^2 and (0.03 * 255)^2


def _cells(n: int, k: int) -> list[tuple[int, int]]:
    k = min(max(k, 1), n)
    return [(i, c) for c in range(k) for i in range(c * n // k, (c + 1) * n // k)]


def compare(a: DataFrame, b: DataFrame, width: int, height: int, channels: int, rows: int = 1, cols: int = 1, threshold: int = 8) -> DataFrame:
    """One row a grid cell and one for all (cell_y, cell_x null): rms, psnr, max_abs, changed, mean0..; a, b: (image_id, y, x, c, v)."""
    d = a.join(sorted_join(b.withColumnRenamed("v", "w")), ["image_id", "y", "x", "c"]).withColumn("d", F.col("w") - F.col("v"))
    per = d.groupBy("image_id", "y", "x").agg(*[F.sum(F.when(F.col("c") == k, F.col("d")).otherwise(0)).alias(f"s{k}") for k in range(channels)], F.sum(F.col("d") * F.col("d")).alias("sq"), F.max(F.abs("d")).alias("worst"))
    per = per.join(small_table(per, _cells(width, cols), "x long, cell_x long"), "x").join(small_table(per, _cells(height, rows), "y long, cell_y long"), "y")
    per = per.groupingSets([["image_id", "cell_y", "cell_x"], ["image_id"]], "image_id", "cell_y", "cell_x")
    n = F.count("*")
    mse = F.sum("sq") / (n * channels)
    out = per.agg(
        *[(F.sum(f"s{k}") / n).alias(f"mean{k}") for k in range(channels)],
        F.sqrt(mse).alias("rms"),
        F.when(mse > 0, F.log10(F.lit(65025.0) / F.when(mse > 0, mse)) * 10).otherwise(F.lit(float("inf"))).alias("psnr"),
        F.max("worst").alias("max_abs"),
        (F.sum(F.when(F.col("worst") > threshold, 1).otherwise(0)) / n).alias("changed"),
        n.alias("pixels"),
    )
    return out


def _ssim_windows(a: DataFrame, b: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, wy, wx, ssim) of 8x8 windows at steps of 4."""
    ww, wh = min(8, width), min(8, height)
    over = lambda n, w, k: small_table(a, [(i, s) for s in range(0, n - w + 1, 4) for i in range(s, s + w)], f"{k} long, w{k} long")
    hit = a.join(sorted_join(b.withColumnRenamed("v", "w")), ["image_id", "y", "x"]).join(over(width, ww, "x"), "x").join(over(height, wh, "y"), "y")
    n = float(ww * wh)
    s = hit.groupBy("image_id", "wy", "wx").agg(F.sum("v").alias("a"), F.sum("w").alias("b"), F.sum(F.col("v") * F.col("v")).alias("aa"), F.sum(F.col("w") * F.col("w")).alias("bb"), F.sum(F.col("v") * F.col("w")).alias("ab"))
    ma, mb = F.col("a") / n, F.col("b") / n
    va, vb, cov = F.col("aa") / n - ma * ma, F.col("bb") / n - mb * mb, F.col("ab") / n - ma * mb
    one = (ma * mb * 2 + C1) * (cov * 2 + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
    return s.select("image_id", "wy", "wx", one.alias("ssim"))


def ssim(a: DataFrame, b: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, ssim): the mean of 8x8 windows at steps of 4; a, b: luma (image_id, y, x, v)."""
    return _ssim_windows(a, b, width, height).groupBy("image_id").agg(F.avg("ssim").alias("ssim"))


def ssim_cells(a: DataFrame, b: DataFrame, width: int, height: int, rows: int, cols: int) -> DataFrame:
    """(image_id, cell_y, cell_x, ssim): the mean over the windows whose centre is in a grid cell.

    A cell without a window's centre is one window as a whole.
    """
    w = _ssim_windows(a, b, width, height)
    cell = lambda n, k: {i: c for i, c in _cells(n, k)}
    place = lambda at, size, n, k: [(s, cell(n, k)[min(n - 1, s + size // 2)]) for s in at]
    ww, wh = min(8, width), min(8, height)
    ys, xs = place(range(0, height - wh + 1, 4), wh, height, rows), place(range(0, width - ww + 1, 4), ww, width, cols)
    found = w.join(small_table(w, ys, "wy long, cell_y long"), "wy").join(small_table(w, xs, "wx long, cell_x long"), "wx").groupBy("image_id", "cell_y", "cell_x").agg(F.avg("ssim").alias("ssim"))
    full = {(cy, cx) for _, cy in ys for _, cx in xs}
    empty = [(cy, cx) for cy in sorted(set(cell(height, rows).values())) for cx in sorted(set(cell(width, cols).values())) if (cy, cx) not in full]
    if not empty:
        return found
    pix = a.join(sorted_join(b.withColumnRenamed("v", "w")), ["image_id", "y", "x"])
    pix = pix.join(small_table(pix, _cells(height, rows), "y long, cell_y long"), "y").join(small_table(pix, _cells(width, cols), "x long, cell_x long"), "x").join(small_table(pix, empty, "cell_y long, cell_x long"), ["cell_y", "cell_x"])
    v, o = F.col("v"), F.col("w")
    m = pix.groupBy("image_id", "cell_y", "cell_x").agg(F.avg("v").alias("ma"), F.avg("w").alias("mb"), F.avg(v * v).alias("aa"), F.avg(o * o).alias("bb"), F.avg(v * o).alias("ab"))
    ma, mb = F.col("ma"), F.col("mb")
    one = (ma * mb * 2 + C1) * ((F.col("ab") - ma * mb) * 2 + C2) / ((ma * ma + mb * mb + C1) * (F.col("aa") - ma * ma + F.col("bb") - mb * mb + C2))
    return found.unionByName(m.select("image_id", "cell_y", "cell_x", one.alias("ssim")))


def sharpness(luma: DataFrame) -> DataFrame:
    """Focus measures over the interior; luma: (image_id, y, x, v) of integers.

    The rows above and below come from one window down each column as structs
    with their own left and right neighbours, so two sorts do for a 3x3 reach.
    """
    across = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    r = luma.select("image_id", "y", "x", "v", F.lag("v").over(across).alias("l"), F.lead("v").over(across).alias("r"))
    row = F.struct("l", "v", "r")
    r = r.withColumns({"a": F.lag(row).over(down), "b": F.lead(row).over(down)}).where("l is not null and r is not null and a is not null and b is not null")
    lap = F.col("v") * 4 - F.col("l") - F.col("r") - F.col("a.v") - F.col("b.v")
    gx = (F.col("a.r") + F.col("r") * 2 + F.col("b.r")) - (F.col("a.l") + F.col("l") * 2 + F.col("b.l"))
    gy = (F.col("b.l") + F.col("b.v") * 2 + F.col("b.r")) - (F.col("a.l") + F.col("a.v") * 2 + F.col("a.r"))
    s = r.select("image_id", "v", lap.alias("lap"), (gx * gx + gy * gy).alias("ten"))
    n = F.count("*")
    spread = lambda x: F.greatest(F.lit(0.0), F.sum(x * x) / n - (F.sum(x) / n) * (F.sum(x) / n))
    return s.groupBy("image_id").agg(spread(F.col("lap")).alias("laplacian_variance"), (F.sum("ten") / n).alias("tenengrad"), F.avg("v").alias("luma_mean"), F.sqrt(spread(F.col("v"))).alias("luma_std"), n.alias("pixels"))


def sharpest(scores: DataFrame, by: str) -> DataFrame:
    """The sharpest image of each burst; ties go to the smaller id."""
    best = F.max_by("image_id", F.struct("laplacian_variance", -F.col("image_id")))
    return scores.groupBy(by).agg(best.alias("image_id"), F.max("laplacian_variance").alias("laplacian_variance"))


def half_u8(plane: DataFrame, width: int, height: int) -> DataFrame:
    """Means of 2x2 boxes, rounded; an odd last row or column is dropped."""
    inside = plane.where((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    return inside.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.shiftright(F.sum("v") + 2, 2).alias("v"))


def half_f32(plane: DataFrame, width: int, height: int) -> DataFrame:
    inside = plane.where((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    return inside.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg((F.sum("v") * 0.25).alias("v"))


def half_mask(plane: DataFrame, width: int, height: int) -> DataFrame:
    """1 where two of four are set."""
    inside = plane.where((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    return inside.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.when(F.sum(F.when(F.col("v") != 0, 1).otherwise(0)) >= 2, 1).otherwise(0).cast("long").alias("v"))


def gradients(plane: DataFrame) -> DataFrame:
    """(image_id, y, x, gx, gy): central differences, one-sided at the edges."""

    def slope(order: str, part: str):
        w = Window.partitionBy("image_id", part).orderBy(order)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        n = F.when(before.isNotNull(), 1.0).otherwise(0.0) + F.when(after.isNotNull(), 1.0).otherwise(0.0)
        return F.when(n > 0, (F.coalesce(after, "v") - F.coalesce(before, "v")) / F.when(n > 0, n))

    return plane.select("image_id", "y", "x", slope("x", "y").alias("gx"), slope("y", "x").alias("gy"))


def measure(pairs: DataFrame, gain: float = 1.0, bias: float = 0.0) -> DataFrame:
    """(image_id, rms, ncc, coverage): correlation of r with m where m is known, over all masked samples."""
    n = F.count("m")
    both = lambda x: F.sum(F.when(F.col("m").isNotNull(), x))
    r, m = F.col("r"), F.col("m")
    e = m * gain + bias - r
    sr, sm = both(r), F.sum(m)
    vr, vm, cov = both(r * r) - sr * sr / n, F.sum(m * m) - sm * sm / n, both(r * m) - sr * sm / n
    ncc = F.when((vr > 0) & (vm > 0), cov / F.sqrt(F.when((vr > 0) & (vm > 0), vr * vm))).otherwise(F.lit(0.0))
    return pairs.groupBy("image_id").agg(F.sqrt(both(e * e) / n).alias("rms"), ncc.alias("ncc"), (n / F.count("*")).alias("coverage"))


def coarse_motion(a: DataFrame, b: DataFrame, width: int, height: int, nx: int, ny: int, margin: int, block: int, radius: int) -> DataFrame:
    """(image_id, by, bx, u, v, cost): the best whole shift of each block at quarter size.

    a, b: quarter planes (image_id, y, x, v). Blocks of 4x4 are compared at all
    shifts within the radius; longer shifts cost a little more, and of equal ones
    the first by row stays.
    """
    places = [(by, bx, (margin + by * block) // 2 + j, (margin + bx * block) // 2 + i) for by in range(ny) for bx in range(nx) for j in range(4) for i in range(4)]
    shifts = [(v, u) for v in range(-radius, radius + 1) for u in range(-radius, radius + 1)]
    p = small_table(a, places, "by long, bx long, y long, x long")
    s = small_table(a, shifts, "sv long, su long")
    left = a.join(p, ["y", "x"]).crossJoin(s)  # the shifts are a fixed query set of (2 radius + 1)^2 rows
    right = b.select("image_id", F.col("y").alias("yy"), F.col("x").alias("xx"), F.col("v").alias("w"))
    hit = left.withColumns({"yy": F.col("y") + F.col("sv"), "xx": F.col("x") + F.col("su")}).join(sorted_join(right), ["image_id", "yy", "xx"])
    cost = hit.groupBy("image_id", "by", "bx", "sv", "su").agg((F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))) + 2 * (F.abs(F.first("su")) + F.abs(F.first("sv")))).alias("cost"), F.count("*").alias("n")).where("n = 16")
    best = F.min(F.struct("cost", "sv", "su"))
    out = cost.groupBy("image_id", "by", "bx").agg(best.alias("m"))
    return out.select("image_id", "by", "bx", F.col("m.su").alias("u"), F.col("m.sv").alias("v"), F.col("m.cost").alias("cost"))


def _bilinear(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples at places given as pixel centres at halves, and which of them are on the plane."""
    h, w = p.shape
    on = (x >= 0) & (y >= 0) & (x <= w) & (y <= h)
    u, v = np.where(on, x, 0.5) - 0.5, np.where(on, y, 0.5) - 0.5
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = u - x0, v - y0
    at = lambda i, j: p[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)]
    top = at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx
    low = at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx
    return top * (1 - fy) + low * fy, on


def _halved(p: np.ndarray) -> np.ndarray:
    h, w = p.shape[0] // 2 * 2, p.shape[1] // 2 * 2
    q = p[:h, :w]
    return (q[::2, ::2] + q[1::2, ::2] + q[::2, 1::2] + q[1::2, 1::2]) / 4


def _edged(p: np.ndarray) -> np.ndarray:
    """p with its edge repeated once all round, flat, for `_taken`."""
    h, w = p.shape
    return p[np.clip(np.arange(-1, h + 1), 0, h - 1)][:, np.clip(np.arange(-1, w + 1), 0, w - 1)].ravel()


def _taken(planes: list[np.ndarray], w: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """What `_bilinear` samples of each plane of width w (by `_edged`), at places that are all on it."""
    u, v = x - 0.5, y - 0.5
    x0, y0 = np.floor(u), np.floor(v)
    fx, fy = u - x0, v - y0
    gx, gy = 1 - fx, 1 - fy
    at = ((y0 + 1) * (w + 2) + (x0 + 1)).astype(np.intp)
    right, low, last = at + 1, at + (w + 2), at + (w + 3)
    return [(p.take(at) * gx + p.take(right) * fx) * gy + (p.take(low) * gx + p.take(last) * fx) * fy for p in planes]


def _median(v: np.ndarray) -> float:
    k = v.size // 2
    if v.size % 2:
        return np.partition(v, k)[k]
    p = np.partition(v, (k - 1, k))
    return (p[k - 1] + p[k]) / 2


def _ncc(a: np.ndarray, b: np.ndarray, flat: float) -> float:
    """Pearson's correlation; `flat` where either does not vary."""
    a, b = a - a.mean(), b - b.mean()
    va, vb = a @ a, b @ b
    return flat if va == 0 or vb == 0 else float(max(min(a @ b / (math.sqrt(va) * math.sqrt(vb)), 1.0), -1.0))


#: A pyramid level's shorter side, and the mask's pixels, are this many at least.
LEAST_SIDE, LEAST_PIXELS = 24, 16
ALIGNED = "scale rotation tx ty gain bias rms ncc coverage".split()


def align_pair(
    ref: np.ndarray, mov: np.ndarray, mask: np.ndarray | None = None, init: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0),
    levels: int = 4, search: int = 4, iterations: int = 40, similarity: bool = True, photometric: bool = True, tolerance: float = 1e-3,
) -> dict:
    """Scale, rotation, shift, gain and bias that carry ref's places to mov's: pyramid, shift search, robust Gauss-Newton.

    Planes are in 0..1; mask says which of ref's pixels count; init is (scale,
    rotation, tx, ty). At the coarsest of `levels` levels above the full size, the whole shift within
    `search` pixels of that level with the best correlation starts the iteration (0: none).
    similarity and photometric: whether scale and rotation, gain and bias are estimated.
    converged: the full size's last step was below the tolerance. Fewer than LEAST_PIXELS pixels give init back.
    """
    on_mask = np.ones(ref.shape, bool) if mask is None else np.asarray(mask) != 0
    if on_mask.sum() < LEAST_PIXELS:
        return {**dict(zip(ALIGNED, (*map(float, init), 1.0, 0.0, 0.0, 0.0, 0.0))), "iterations": 0, "converged": False}
    planes = [(ref, mov, on_mask)]
    while len(planes) <= levels and min(planes[-1][0].shape) // 2 >= LEAST_SIDE:
        r, m, k = planes[-1]
        planes.append((_halved(r), _halved(m), _halved(k.astype(float)) >= 0.5))
    top = len(planes) - 1
    a, b = init[0] * math.cos(init[1]) - 1, init[0] * math.sin(init[1])
    tx, ty, gain, bias = init[2] / 2**top, init[3] / 2**top, 1.0, 0.0
    rms = ncc = cover = 0.0
    steps, converged = 0, False
    for k in range(top, -1, -1):
        r, m, counts = planes[k]
        h, w = r.shape
        yy, xx = np.mgrid[:h, :w] + 0.5
        dx, dy, flat, counts = (xx - w / 2).ravel(), (yy - h / 2).ravel(), r.ravel(), counts.ravel()
        known, edged = int(counts.sum()), [_edged(p) for p in (m, *np.gradient(m))]

        def turned(a, b):
            return w / 2 + (1 + a) * dx - b * dy, h / 2 + b * dx + (1 + a) * dy  # noqa: B023

        def placed(x, y):
            """The pixels that count and are on the moved plane, with their places there."""
            at = np.flatnonzero((x >= 0) & (y >= 0) & (x <= m.shape[1]) & (y <= m.shape[0]) & counts)  # noqa: B023
            return at, x[at], y[at]

        def score(tx, ty):
            at, x, y = placed(still[0] + tx, still[1] + ty)  # noqa: B023
            return -2.0 if 2 * at.size < known else _ncc(_taken(edged[:1], m.shape[1], x, y)[0], flat[at], -2.0)  # noqa: B023

        if k == top and search:
            still = turned(a, b)
            best = max((score(tx + i, ty + j), -j, -i) for j in range(-search, search + 1) for i in range(-search, search + 1))
            tx, ty = tx - best[2], ty - best[1]
        free = np.array([similarity, similarity, True, True, photometric, photometric])
        converged = False
        for _ in range(iterations):
            x, y = turned(a, b)
            at, x, y = placed(x + tx, y + ty)
            if at.size < LEAST_PIXELS:
                break
            s, sy, sx = _taken(edged, m.shape[1], x, y)
            ox, oy = dx[at], dy[at]
            ee = gain * s + bias - flat[at]
            J = np.stack([gain * (sx * ox + sy * oy), gain * (-sx * oy + sy * ox), gain * sx, gain * sy, s, np.ones_like(s)])[free]
            cut = max(1e-4, 1.345 * 1.4826 * _median(np.abs(ee - _median(ee))))
            weighed = J * np.minimum(1.0, cut / np.maximum(np.abs(ee), 1e-12))
            A = weighed @ J.T
            step = np.zeros(6)
            step[free] = np.linalg.lstsq(A + np.diag(np.diag(A)) * 1e-6, -weighed @ ee, rcond=None)[0]
            a, b, tx, ty, gain, bias = (p + d for p, d in zip((a, b, tx, ty, gain, bias), step.tolist()))
            steps += 1
            if max(abs(step[2]), abs(step[3]), abs(step[0]) * w, abs(step[1]) * w) < tolerance:
                converged = True
                break
        x, y = turned(a, b)
        at, x, y = placed(x + tx, y + ty)
        if at.size:
            s = _taken(edged[:1], m.shape[1], x, y)[0]
            e = gain * s + bias - flat[at]
            rms, cover = float(np.sqrt((e * e).mean())), float(at.size / known)
            ncc = _ncc(s, flat[at], 0.0)
        if k:
            tx, ty = 2 * tx, 2 * ty
    return {"scale": math.hypot(1 + a, b), "rotation": math.atan2(b, 1 + a), "tx": tx, "ty": ty, "gain": gain, "bias": bias, "rms": rms, "ncc": ncc, "coverage": cover, "iterations": steps, "converged": converged}


def align_similarity(pairs: DataFrame, **options) -> DataFrame:
    """One solver a pair, pairs in parallel; pairs: (pair_id, width, ref array, mov array), values in 0..1.

    Optional columns mask (array, not 0 where a pixel counts) and init (array of
    scale, rotation, tx, ty); options as of `align_pair`.
    """
    out = ", ".join(["pair_id long", *(f"{c} double" for c in ALIGNED), "iterations long", "converged boolean"])
    more = [c for c in ("mask", "init") if c in pairs.columns]

    def run(frames):
        for f in frames:
            got = []
            for row in f.to_dict("records"):
                w = row["width"]
                own = {"mask": None if row.get("mask") is None else np.asarray(row["mask"]).reshape(-1, w)} | ({"init": tuple(row["init"])} if row.get("init") is not None else {})
                got.append({"pair_id": row["pair_id"], **align_pair(np.asarray(row["ref"], float).reshape(-1, w), np.asarray(row["mov"], float).reshape(-1, w), **own, **options)})
            yield pd.DataFrame(got, columns=[c.split()[0] for c in out.split(", ")])

    return pairs.select("pair_id", "width", "ref", "mov", *more).mapInPandas(run, out)


def motion_pair(a: np.ndarray, b: np.ndarray, margin: int, block: int, radius: int, lost: float = 1.5) -> list[tuple]:
    """(by, bx, dx, dy, brightness, structure, texture, status) of each block: search at quarter, then half size, then sub-pixel steps."""
    half = lambda p: ((p[:-1:2, :-1:2] + p[1::2, :-1:2] + p[:-1:2, 1::2] + p[1::2, 1::2] + 2) // 4).astype(np.int64)
    even = lambda p: p[: p.shape[0] // 2 * 2, : p.shape[1] // 2 * 2].astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    ha, hb = half(even(a)), half(even(b))
    qa, qb = half(even(ha)), half(even(hb))
    size = 2 * block
    out = []

    def patch(p, y, x, n):
        ys, xs = np.arange(y, y + n), np.arange(x, x + n)
        inside = (ys[0] >= 0) and (xs[0] >= 0) and ys[-1] < p.shape[0] and xs[-1] < p.shape[1]
        return p[np.ix_(ys, xs)] if inside else None

    def search(pa, pb, y, x, n, cy, cx, reach):
        ref, best = patch(pa, y, x, n), None
        for v in range(cy - reach, cy + reach + 1):
            for u in range(cx - reach, cx + reach + 1):
                t = patch(pb, y + v, x + u, n)
                if t is not None:
                    cost = int(((ref - t) ** 2).sum()) + 2 * (abs(u) + abs(v))
                    if best is None or cost < best[0]:
                        best = (cost, v, u)
        return best

    def shifted(y, x, dy, dx):
        gy, gx = np.mgrid[y : y + size, x : x + size]
        return _bilinear(b.astype(float), gx + dx + 0.5, gy + dy + 0.5)[0]

    for by in range((ha.shape[0] - 2 * margin) // block):
        for bx in range((ha.shape[1] - 2 * margin) // block):
            y, x = margin + by * block, margin + bx * block
            ref = a[2 * y : 2 * y + size, 2 * x : 2 * x + size].astype(float)
            texture, dx, dy, status = float(ref.std()), 0.0, 0.0, 0
            if texture < lost:
                status = 2
            else:
                q = search(qa, qb, y // 2, x // 2, 4, 0, 0, radius)
                if q is None or abs(q[1]) == radius or abs(q[2]) == radius:
                    status = 1
                else:
                    _, v, u = search(ha, hb, y, x, block, 2 * q[1], 2 * q[2], 2)
                    dx, dy = base = (2.0 * u, 2.0 * v)
                    gy, gx = np.gradient(a[2 * y - 1 : 2 * y + size + 1, 2 * x - 1 : 2 * x + size + 1].astype(float))
                    gx, gy = gx[1:-1, 1:-1], gy[1:-1, 1:-1]
                    H = np.array([[(gx * gx).sum(), (gx * gy).sum()], [(gx * gy).sum(), (gy * gy).sum()]])
                    det = np.linalg.det(H)
                    if det > 1 and det > 1e-6 * np.trace(H) ** 2:
                        for _ in range(4):
                            e = shifted(2 * y, 2 * x, dy, dx) - ref
                            e -= e.mean()
                            ux, uy = np.linalg.solve(H, [(gx * e).sum(), (gy * e).sum()])
                            dx, dy = dx - float(np.clip(ux, -1, 1)), dy - float(np.clip(uy, -1, 1))
                            if ux * ux + uy * uy < 1e-4:
                                break
                        if abs(dx - base[0]) > 2 or abs(dy - base[1]) > 2:
                            dx, dy = base
            d = shifted(2 * y, 2 * x, dy, dx) - ref
            out.append((by, bx, dx, dy, float(d.mean()), float(d.std()), texture, status))
    return out


def block_motion(pairs: DataFrame, margin: int = 16, block: int = 8, radius: int = 6, lost: float = 1.5) -> DataFrame:
    """One row a block; pairs: (pair_id, width, a array, b array) of full-size luma."""
    out = "pair_id long, by long, bx long, dx double, dy double, brightness double, structure double, texture double, status long"

    def run(frames):
        for f in frames:
            rows = [(p, *r) for p, w, x, y in zip(f["pair_id"], f["width"], f["a"], f["b"]) for r in motion_pair(np.asarray(x).reshape(-1, w), np.asarray(y).reshape(-1, w), margin, block, radius, lost)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return pairs.select("pair_id", "width", "a", "b").mapInPandas(run, out)


def block_residual(a: np.ndarray, b: np.ndarray, motion: dict, margin: int, block: int) -> dict:
    """rms about the mean of each block's least residual over no motion, its own and its neighbours', at half size."""
    out = {}
    for by, bx in motion:
        y, x = margin + by * block, margin + bx * block
        gy, gx = np.mgrid[y : y + block, x : x + block]
        ref = a[y : y + block, x : x + block].astype(float)
        ways = [(0.0, 0.0)] + [motion[k] for j in (-1, 0, 1) for i in (-1, 0, 1) if (k := (by + j, bx + i)) in motion]
        e = np.stack([_bilinear(b.astype(float), gx + dx / 2 + 0.5, gy + dy / 2 + 0.5)[0] - ref for dx, dy in ways])
        least = np.take_along_axis(e, np.abs(e).argmin(0)[None], 0)[0]
        out[by, bx] = float(least.std())
    return out


def residual_rows(pairs: DataFrame, margin: int = 16, block: int = 8, radius: int = 6, lost: float = 1.5) -> DataFrame:
    """(pair_id, by, bx, residual) of each block after its motion; pairs: (pair_id, width, a array, b array) of full-size luma.

    With columns half_a and half_b, planes of half size, those are compared; else they are made from a and b.
    """
    given = [c for c in ("half_a", "half_b") if c in pairs.columns]
    half = lambda q: (q[:-1:2, :-1:2] + q[1::2, :-1:2] + q[:-1:2, 1::2] + q[1::2, 1::2] + 2) // 4

    def run(frames):
        for f in frames:
            rows = []
            for x in f.to_dict("records"):
                w = x["width"]
                a, b = (np.asarray(x[k]).reshape(-1, w).astype(np.int64) for k in "ab")
                motion = {(r[0], r[1]): (r[2], r[3]) for r in motion_pair(a, b, margin, block, radius, lost)}
                planes = [np.asarray(x[k]).reshape(-1, w // 2) for k in given] if len(given) == 2 else [half(p[: p.shape[0] // 2 * 2, : w // 2 * 2]) for p in (a, b)]
                rows += [(x["pair_id"], *k, d) for k, d in block_residual(*planes, motion, margin, block).items()]
            yield pd.DataFrame(rows, columns=["pair_id", "by", "bx", "residual"])

    return pairs.select("pair_id", "width", "a", "b", *given).mapInPandas(run, "pair_id long, by long, bx long, residual double")
