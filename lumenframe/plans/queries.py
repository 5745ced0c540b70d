"""One query for each operator, with SQL that says the same by other means where SQL can.

Images come from `embeddings`: 64 floats are an 8x8 plane, or a 4x4 image of four
channels; bytes are floor(clamp(v * 255 + 127.5) + 0.5).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import analysis as X
from ..operators import color as C
from ..operators import geometry as G
from ..operators import kernels as R
from ..operators import layout as L
from ..operators import tiling as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---- the tables that the SQL starts from
FIELD = "fld AS (SELECT vec_id AS image_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
PLANE = FIELD + ", pix AS (SELECT image_id, pos // 8 AS y, pos % 8 AS x, CAST(0 AS BIGINT) AS c, v FROM fld)"
BYTE = "CAST(floor(least(greatest(v * 255 + 127.5, 0), 255) + 0.5) AS BIGINT)"
PLANE8 = FIELD + f", pix AS (SELECT image_id, pos // 8 AS y, pos % 8 AS x, CAST(0 AS BIGINT) AS c, {BYTE} AS v FROM fld)"
RGBA8 = FIELD + f", pix AS (SELECT image_id, pos // 16 AS y, pos // 4 % 4 AS x, pos % 4 AS c, {BYTE} AS v FROM fld)"
RGBA32 = FIELD + ", pix AS (SELECT image_id, pos // 16 AS y, pos // 4 % 4 AS x, pos % 4 AS c, v FROM fld)"
RGB = "rgb AS (SELECT vec_id AS image_id, p, embedding[3 * p + 1] + CAST(0.5 AS DOUBLE) AS r, embedding[3 * p + 2] + CAST(0.5 AS DOUBLE) AS g, embedding[3 * p + 3] + CAST(0.5 AS DOUBLE) AS b FROM embeddings, (SELECT unnest(range(21)) AS p))"
WIDE = RGBA8 + ", w AS (SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) AS a FROM pix GROUP BY ALL)"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fld(spark, sf):
    return L.field(table(spark, sf, "embeddings"), "vec_id", "embedding")


def plane(spark, sf):
    return L.to_pixels(fld(spark, sf), 8)


def plane8(spark, sf):
    return plane(spark, sf).withColumn("v", L.as_u8(F.col("v") * 255 + 127.5))


def rgba32(spark, sf):
    return L.to_pixels(fld(spark, sf), 4, 4)


def rgba8(spark, sf):
    return rgba32(spark, sf).withColumn("v", L.as_u8(F.col("v") * 255 + 127.5))


def rgb(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("p"))
    at = lambda k: F.element_at("embedding", F.col("p") * 3 + k).cast("double") + 0.5
    return e.select("image_id", F.col("p").cast("long").alias("p"), at(1).alias("r"), at(2).alias("g"), at(3).alias("b"))


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- M: element-wise
def _map(name, column, expression, source=FIELD):
    @query(name, f"WITH {source} SELECT image_id, pos, round({expression}, 6) AS v FROM fld")
    def run(spark, sf):
        return fld(spark, sf).select("image_id", "pos", F.round(column(F.col("v")), 6).alias("v"))


_map("m1_affine", lambda v: K.affine(v, 2.5, -0.25), "v * 2.5 - 0.25")
_map("m2_affine_clamp", lambda v: K.affine_clamp(v, 2.0, 0.1, -0.2, 0.4), "least(greatest(v * 2.0 + 0.1, -0.2), 0.4)")
_map("m3_abs", K.absolute, "abs(v)")
_map("m4_log", lambda v: K.log(F.abs(v) + 0.5), "ln(abs(v) + 0.5)")
_map("m5_sqrt", lambda v: K.sqrt(F.abs(v)), "sqrt(abs(v))")
_map("m6_exp", K.exp, "exp(v)")
_map("m7_pow", lambda v: K.power(F.abs(v), 1.7), "pow(abs(v), 1.7)")


def _combine(name, column, expression):
    sql = f"WITH {FIELD} SELECT p.image_id // 2 AS pair_id, p.pos, round({expression}, 6) AS v FROM fld p JOIN fld q ON q.image_id = p.image_id + 1 AND q.pos = p.pos WHERE p.image_id % 2 = 0"

    @query(name, sql)
    def run(spark, sf):
        e = table(spark, sf, "embeddings")
        left = e.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").alias("a"))
        right = e.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").alias("b"))
        both = left.join(right, "pair_id").select("pair_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "s"))
        a, b = F.col("s.a").cast("double"), F.col("s.b").cast("double")
        return both.select("pair_id", F.col("pos").cast("long").alias("pos"), F.round(column(a, b), 6).alias("v"))


_combine("m8_add", K.add, "p.v + q.v")
_combine("m9_sub", K.sub, "p.v - q.v")
_combine("m10_mul", K.mul, "p.v * q.v")
_combine("m11_min", K.minimum, "least(p.v, q.v)")
_combine("m12_max", K.maximum, "greatest(p.v, q.v)")
_combine("m13_lerp", lambda a, b: K.lerp(a, b, 0.25), "p.v * 0.75 + q.v * 0.25")
_combine("m14_wsum", lambda a, b: K.weighted_sum(a, b, 0.3, -1.2), "p.v * 0.3 + q.v * (-1.2)")

STOPS = [(0.0, 0.0, 10.0, 255.0, 255.0), (0.25, 200.0, 30.0, 20.0, -1.0), (1.0, 255.0, 255.0, 0.0, 64.0)]
_LUT = "lut AS (SELECT i AS idx, CASE WHEN i / 255.0::DOUBLE <= 0.25 THEN [0 + 200 * u, 10 + 20 * u, 255 - 235 * u, 255] ELSE [200 + 55 * u, 30 + 225 * u, 20 - 20 * u, 255 - 191 * u] END AS k FROM (SELECT i, CASE WHEN i / 255.0::DOUBLE <= 0.25 THEN (i / 255.0::DOUBLE) / 0.25 ELSE (i / 255.0::DOUBLE - 0.25) / 0.75 END AS u FROM (SELECT unnest(range(256)) AS i)))"
_PICK = ", ".join(f"CAST(floor(k[{n + 1}]) AS BIGINT) AS {c}" for n, c in enumerate("rgba"))


@query("m15_gradient", f"WITH {_LUT} SELECT idx, {_PICK} FROM lut")
def m15(spark, sf):
    return R.gradient(spark, STOPS, 256)


@query("m16_lookup", f"WITH {FIELD}, {_LUT}, f AS (SELECT *, CAST(floor(least(greatest((v + 0.3) * (255 / CAST(0.6 AS DOUBLE)), 0), 255)) AS BIGINT) AS i FROM fld) SELECT image_id, pos, {_PICK} FROM f JOIN lut ON idx = i")
def m16(spark, sf):
    return R.lookup(fld(spark, sf), R.gradient(spark, STOPS, 256), 256, -0.3, 0.3).select("image_id", "pos", *"rgba")


@query("m17_alloc", "SELECT CAST(unnest(range(48)) AS BIGINT) AS pos, CAST(0 AS BIGINT) AS v")
def m17(spark, sf):
    return spark.range(48).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("v"))


# ---- A: reductions
@query("a1_minmax", f"WITH {FIELD} SELECT image_id, round(min(v), 6) AS min, round(max(v), 6) AS max FROM fld GROUP BY image_id")
def a1(spark, sf):
    return rounded(R.reduce_minmax(fld(spark, sf), ["image_id"]), "min", "max")


@query("a2_sum", f"WITH {FIELD} SELECT image_id, round(sum(v), 6) AS sum FROM fld GROUP BY image_id")
def a2(spark, sf):
    return rounded(R.reduce_sum(fld(spark, sf), ["image_id"]), "sum")


@query("a3_mean", f"WITH {FIELD} SELECT image_id, round(avg(v), 6) AS mean FROM fld GROUP BY image_id")
def a3(spark, sf):
    return rounded(R.reduce_mean(fld(spark, sf), ["image_id"]), "mean")


@query("a4_histogram", f"WITH {FIELD}, h AS (SELECT CAST(trunc(v * 32.0) AS BIGINT) AS bin, count(*) AS n FROM fld WHERE v * 32.0 > -1 AND v * 32.0 < 16 GROUP BY 1) SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(16)) AS b) LEFT JOIN h ON bin = b")
def a4(spark, sf):
    return R.reduce_histogram(fld(spark, sf), 16, 0.0, 0.5)


@query("a5_stride", f"WITH {FIELD} SELECT image_id, round(sum(v), 6) AS sum FROM fld WHERE pos % 3 = 0 GROUP BY image_id")
def a5(spark, sf):
    return rounded(R.reduce_sum(fld(spark, sf), ["image_id"], stride=3), "sum")


# ---- K: stencils
KERNEL = [[1.0, 2.0, 1.0], [0.0, -1.0, 0.5], [-1.0, 0.0, 3.0]]
_TAPS = "k(ky, kx, w) AS (VALUES " + ", ".join(f"({j}, {i}, CAST({w} AS DOUBLE))" for j, row in enumerate(KERNEL) for i, w in enumerate(row)) + ")"


def _stencil(name, source, rows, size, edge, place):
    n = size
    where = f"WHERE d.y + ky - 1 BETWEEN 0 AND {n - 1} AND d.x + kx - 1 BETWEEN 0 AND {n - 1}" if edge == "zero" else ""
    sql = f"WITH {source}, {_TAPS} SELECT d.image_id, d.y, d.x, d.c, round(sum(s.v * w) * 0.25 + 0.5, 4) AS v FROM pix d CROSS JOIN k JOIN pix s ON s.image_id = d.image_id AND s.c = d.c AND s.y = {place('d.y + ky - 1')} AND s.x = {place('d.x + kx - 1')} {where} GROUP BY ALL"

    @query(name, sql)
    def run(spark, sf):
        return rounded(R.stencil(rows(spark, sf), n, n, KERNEL, 4.0, 0.5, edge), "v", digits=4)


_stencil("k1_stencil_clamp", PLANE, plane, 8, "clamp", lambda e: f"least(greatest({e}, 0), 7)")
_stencil("k1_stencil_wrap", PLANE, plane, 8, "wrap", lambda e: f"({e} + 8) % 8")
_stencil("k1_stencil_zero", PLANE, plane, 8, "zero", lambda e: e)
_stencil("k2_stencil_hwc", RGBA32, rgba32, 4, "clamp", lambda e: f"least(greatest({e}, 0), 3)")


# ---- G: geometry
def _axis(name, n, m, kind):
    """The taps (d, s, w) of one axis from n samples to m, by the filters' own formulas; places beyond the edges are the edge's."""
    sc = f"(CAST({n} AS DOUBLE) / {m})"
    at = f"(SELECT d, (d + 0.5) * {sc} - 0.5 AS c FROM (SELECT CAST(unnest(range({m})) AS BIGINT) AS d))"
    edge = lambda e: f"least(greatest(CAST({e} AS BIGINT), 0), {n - 1})"
    if n == m and kind != "area":
        return f"{name} AS (SELECT d, d AS s, CAST(1 AS DOUBLE) AS w FROM {at})"
    if kind == "nearest":
        return f"{name} AS (SELECT d, {edge('floor(c + 0.5)')} AS s, CAST(1 AS DOUBLE) AS w FROM {at})"
    if kind == "bilinear":
        return f"{name} AS (SELECT d, {edge('floor(c) + k')} AS s, 1 - abs(floor(c) + k - c) AS w FROM {at}, (SELECT unnest(range(2)) AS k))"
    if kind == "bicubic":
        w = "CASE WHEN t < 1 THEN 1.5 * t * t * t - 2.5 * t * t + 1 ELSE -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2 END"
        return f"{name} AS (SELECT d, {edge('q')} AS s, {w} AS w FROM (SELECT d, floor(c) + k AS q, abs(floor(c) + k - c) AS t FROM {at}, (SELECT unnest(range(-1, 3)) AS k)))"
    if kind == "lanczos3":
        w = "CASE WHEN abs(t) < 1e-7 THEN 1 ELSE 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t * pi() * t) END"
        return f"{name} AS (SELECT d, {edge('q')} AS s, w / sum(w) OVER (PARTITION BY d) AS w FROM (SELECT d, q, {w} AS w FROM (SELECT d, q, (q - c) / greatest(1, {sc}) AS t FROM {at}, (SELECT unnest(range(-12, {n + 12})) AS q)) WHERE abs(t) < 3))"
    return f"{name} AS (SELECT d, s, w / {sc} AS w FROM (SELECT d, s, least(s + 1, (d + 1) * {sc}) - greatest(s, d * {sc}) AS w FROM {at}, (SELECT CAST(unnest(range({n})) AS BIGINT) AS s)) WHERE w > 1e-9)"


def _resampled(inner, digits=4):
    return f"SELECT p.image_id, ty.d AS y, tx.d AS x, p.c, round(sum(p.v * tx.w * ty.w), {digits}) AS v FROM {inner} p JOIN tx ON p.x = tx.s JOIN ty ON p.y = ty.s GROUP BY ALL"


def _out(sql):
    return f"SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(c AS BIGINT) AS c, v FROM ({sql})"


def _resize(name, kind, to):
    @query(name, f"WITH {PLANE}, {_axis('tx', 8, to[0], kind)}, {_axis('ty', 8, to[1], kind)} {_out(_resampled('pix'))}")
    def run(spark, sf):
        return rounded(G.resize(plane(spark, sf), (8, 8), to, kind), "v", digits=4)


_resize("g1_resize_nearest", "nearest", (5, 3))
_resize("g2_resize_bilinear", "bilinear", (5, 11))
_resize("g3_resize_bicubic", "bicubic", (5, 11))
_resize("g4_resize_lanczos3", "lanczos3", (5, 11))
_resize("g5_resize_area", "area", (5, 3))
_resize("g7_resize_hwc", "bilinear", (3, 4))
_resize("g17_resample", "nearest", (13, 6))


def _fixed(name):
    """Area weights of 8 to 5 samples in 1/16384, the largest (of equals the first) with what is left of 16384."""
    whole = f"SELECT d, s, CAST(floor(w * 16384 + 0.5) AS BIGINT) AS w FROM {name}0"
    return f"{_axis(name + '0', 8, 5, 'area')}, {name} AS (SELECT d, s, CAST(w + CASE WHEN row_number() OVER (PARTITION BY d ORDER BY w DESC, s) = 1 THEN 16384 - sum(w) OVER (PARTITION BY d) ELSE 0 END AS BIGINT) AS w FROM ({whole}))"


@query("g6_resize_area_u8", f"WITH {PLANE8}, {_fixed('tx')}, {_fixed('ty')}, h AS (SELECT image_id, y, tx.d AS x, c, (CAST(sum(v * w) AS BIGINT) + 32) >> 6 AS v FROM pix JOIN tx ON x = s GROUP BY ALL) {_out('SELECT image_id, ty.d AS y, x, c, (CAST(sum(v * w) AS BIGINT) + 2097152) >> 22 AS v FROM h JOIN ty ON y = s GROUP BY ALL')}")
def g6(spark, sf):
    return G.resize_u8(plane8(spark, sf), (8, 8), (5, 5), "area")


_T43 = f"{_axis('tx', 4, 3, 'bilinear')}, {_axis('ty', 4, 5, 'bilinear')}"


@query("g8_resize_chw", f"WITH {RGBA32}, {_T43}, r AS ({_resampled('pix')}) SELECT image_id, CAST((c * 5 + y) * 3 + x AS BIGINT) AS pos, v FROM r")
def g8(spark, sf):
    out = G.resize(rgba32(spark, sf), (4, 4), (3, 5))
    return rounded(out.select("image_id", L.chw(3, 5).cast("long").alias("pos"), "v"), "v", digits=4)


def _u8(sql):
    return f"SELECT image_id, y, x, c, CAST(floor(least(greatest(v, 0), 255) + 0.5) AS BIGINT) AS v FROM ({sql})"


_R55 = f"{_axis('tx', 8, 5, 'bilinear')}, {_axis('ty', 8, 5, 'bilinear')}"


@query("g9_resize_u8", f"WITH {PLANE8}, {_R55} {_out(_u8(_resampled('pix', 6)))}")
def g9(spark, sf):
    return G.resize_u8(plane8(spark, sf), (8, 8), (5, 5))


def _grid(w, h, channels):
    return f"grid AS (SELECT DISTINCT image_id, y, x, c FROM (SELECT DISTINCT image_id FROM pix) CROSS JOIN (SELECT unnest(range({h})) AS y) CROSS JOIN (SELECT unnest(range({w})) AS x) CROSS JOIN (SELECT unnest(range({channels})) AS c))"


def _padded(inner, ox, oy, fill):
    pick = "CASE c " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(fill)) + " ELSE 0 END"
    return f"SELECT g.image_id, g.y, g.x, g.c, CAST(coalesce(s.v, {pick.replace('CASE c', 'CASE g.c')}) AS BIGINT) AS v FROM grid g LEFT JOIN ({inner}) s ON s.image_id = g.image_id AND s.c = g.c AND s.y + {oy} = g.y AND s.x + {ox} = g.x"


#: 4x4 into 7x5: scaled by 5 / 4 to 5x5, one column in from the left.
_RECT = (1, 0, 5, 5)
_LB = f"{_axis('tx', 4, 5, 'bilinear')}, {_axis('ty', 4, 5, 'bilinear')}"


@query("g10_letterbox_u8", f"WITH {RGBA8}, {_grid(7, 5, 4)}, {_LB} {_padded(_u8(_resampled('pix', 6)), _RECT[0], _RECT[1], [1, 2, 3, 200])}")
def g10(spark, sf):
    return G.letterbox_u8(rgba8(spark, sf), (4, 4), (7, 5), 4, [1, 2, 3, 200])


@query("g11_pad_u8", f"WITH {RGBA8}, {_grid(6, 5, 4)} {_padded('SELECT * FROM pix', 3, -1, [9, 8, 7, 255])}")
def g11(spark, sf):
    return G.pad(rgba8(spark, sf), (6, 5), 4, (3, -1), [9, 8, 7, 255])


def _cropped(at, to, n=8):
    return f"SELECT p.image_id, CAST(dy AS BIGINT) AS y, CAST(dx AS BIGINT) AS x, p.c, p.v FROM (SELECT unnest(range({to[1]})) AS dy) CROSS JOIN (SELECT unnest(range({to[0]})) AS dx) JOIN pix p ON p.y = least(greatest(dy + {at[1]}, 0), {n - 1}) AND p.x = least(greatest(dx + {at[0]}, 0), {n - 1})"


@query("g12_crop_u8", f"WITH {PLANE8} {_cropped((-2, 5), (6, 5))}")
def g12(spark, sf):
    return G.crop(plane8(spark, sf), (8, 8), (-2, 5), (6, 5))


@query("g13_center_crop_u8", f"WITH {PLANE8} {_cropped((1, 2), (5, 3))}")
def g13(spark, sf):
    return G.center_crop(plane8(spark, sf), (8, 8), (5, 3))


def _move(name, y, x, f):
    @query(name, f"WITH {RGBA8} SELECT image_id, {y} AS y, {x} AS x, c, v FROM pix")
    def run(spark, sf):
        return f(rgba8(spark, sf))


_move("g14_flip_horizontal", "y", "3 - x", lambda p: G.flip_horizontal(p, 4))
_move("g15_flip_vertical", "3 - y", "x", lambda p: G.flip_vertical(p, 4))
_move("g16_rotate_90", "3 - x", "y", lambda p: G.rotate_90(p, (4, 4), 1))
_move("g16_rotate_270", "x", "3 - y", lambda p: G.rotate_90(p, (4, 4), -1))


@query("g18_orientation", f"WITH {RGBA8}, o AS (SELECT *, image_id % 8 + 1 AS o FROM pix) SELECT image_id, CASE WHEN o IN (1, 2) THEN y WHEN o IN (3, 4) THEN 3 - y WHEN o IN (5, 6) THEN x ELSE 3 - x END AS y, CASE WHEN o IN (1, 4) THEN x WHEN o IN (2, 3) THEN 3 - x WHEN o IN (5, 8) THEN y ELSE 3 - y END AS x, c, v FROM o")
def g18(spark, sf):
    return G.orient(rgba8(spark, sf), (4, 4), F.col("image_id") % 8 + 1)


MATRIX = [0.9, -0.3, 1.4, 0.25, 1.1, -1.5]


def _warp(name, kind):
    m = [f"CAST({v} AS DOUBLE)" for v in MATRIX]
    grid = f"wg AS (SELECT dy, dx, {m[0]} * (dx + 0.5) + {m[1]} * (dy + 0.5) + {m[2]} AS sx, {m[3]} * (dx + 0.5) + {m[4]} * (dy + 0.5) + {m[5]} AS sy FROM (SELECT CAST(unnest(range(6)) AS BIGINT) AS dy), (SELECT CAST(unnest(range(7)) AS BIGINT) AS dx)), wi AS (SELECT * FROM wg WHERE sx BETWEEN 0 AND 8 AND sy BETWEEN 0 AND 8)"
    edge = lambda e: f"least(greatest(CAST({e} AS BIGINT), 0), 7)"
    cubic = lambda t: f"CASE WHEN {t} < 1 THEN 1.5 * {t} * {t} * {t} - 2.5 * {t} * {t} + 1 ELSE -0.5 * {t} * {t} * {t} + 2.5 * {t} * {t} - 4 * {t} + 2 END"
    weigh = {"bilinear": lambda t: f"(1 - {t})", "bicubic": lambda t: f"({cubic(t)})"}.get(kind)
    near = {"bilinear": "range(2)", "bicubic": "range(-1, 3)"}.get(kind)
    if kind == "nearest":
        taps = f"SELECT dy, dx, {edge('floor(sy)')} AS sy, {edge('floor(sx)')} AS sx, CAST(1 AS DOUBLE) AS w FROM wi"
    else:
        taps = f"SELECT dy, dx, {edge('qy')} AS sy, {edge('qx')} AS sx, {weigh('ty')} * {weigh('tx')} AS w FROM (SELECT dy, dx, qy, qx, abs(qy - (sy - 0.5)) AS ty, abs(qx - (sx - 0.5)) AS tx FROM (SELECT *, floor(sy - 0.5) + j AS qy, floor(sx - 0.5) + i AS qx FROM wi, (SELECT unnest({near}) AS j), (SELECT unnest({near}) AS i)))"
    inner = "SELECT image_id, CAST(dy AS BIGINT) AS y, CAST(dx AS BIGINT) AS x, c, round(sum(v * w), 6) AS v FROM pix JOIN t ON y = sy AND x = sx GROUP BY image_id, dy, dx, c"
    sql = f"WITH {PLANE8}, {grid}, t AS ({taps}) {_u8(inner)} UNION ALL SELECT DISTINCT image_id, dy, dx, CAST(0 AS BIGINT), CAST(77 AS BIGINT) FROM pix, wg WHERE NOT (sx BETWEEN 0 AND 8 AND sy BETWEEN 0 AND 8)"

    @query(name, sql)
    def run(spark, sf):
        return G.warp_affine_u8(plane8(spark, sf), (8, 8), (7, 6), MATRIX, 1, kind, [77])


for _kind in ("nearest", "bilinear", "bicubic"):
    _warp(f"g19_warp_{_kind}", _kind)


@query("g20_similarity_matrix", "WITH s AS (SELECT vec_id, 1 + embedding[1]::DOUBLE AS k, embedding[2]::DOUBLE AS r, embedding[3]::DOUBLE AS tx, embedding[4]::DOUBLE AS ty FROM embeddings) SELECT vec_id, round(k * cos(r), 6) AS m0, round(-k * sin(r), 6) AS m1, round(4 - k * cos(r) * 4 + k * sin(r) * 3 + tx, 6) AS m2, round(k * sin(r), 6) AS m3, round(k * cos(r), 6) AS m4, round(3 - k * sin(r) * 4 - k * cos(r) * 3 + ty, 6) AS m5 FROM s")
def g20(spark, sf):
    e = lambda k: F.element_at("embedding", k).cast("double")
    m = table(spark, sf, "embeddings").select("vec_id", K.similarity_matrix(e(1) + 1, e(2), e(3), e(4), 4.0, 3.0).alias("m"))
    return rounded(m.select("vec_id", "m.*"), *[f"m{k}" for k in range(6)])


_ASPECT = "WITH s AS (SELECT p_partkey AS id, p_size * 40 + 100 AS fw, 1000 AS fh, 160 AS w, 120 AS h FROM part), t AS (SELECT *, CAST(fw AS DOUBLE) / fh AS want, 160 / CAST(120 AS DOUBLE) AS have FROM s), u AS (SELECT id, CASE WHEN abs(have - want) <= 0.02 * want OR want > have THEN 160 ELSE CAST(greatest(1, floor(120 * want + 0.5)) AS BIGINT) END AS nw, CASE WHEN abs(have - want) > 0.02 * want AND want > have THEN CAST(greatest(1, floor(160 / want + 0.5)) AS BIGINT) ELSE 120 END AS nh FROM t) SELECT id, (160 - nw) // 2 AS x, (120 - nh) // 2 AS y, CAST(nw AS BIGINT) AS w, CAST(nh AS BIGINT) AS h FROM u"


@query("g21_crop_to_aspect", _ASPECT.replace("(160 - nw) // 2 AS x", "CAST((160 - nw) // 2 AS BIGINT) AS x").replace("(120 - nh) // 2 AS y", "CAST((120 - nh) // 2 AS BIGINT) AS y"))
def g21(spark, sf):
    p = table(spark, sf, "part")
    r = K.crop_to_aspect((F.col("p_size") * 40 + 100).cast("double"), F.lit(1000.0), F.lit(160), F.lit(120))
    return p.select(F.col("p_partkey").alias("id"), r.alias("r")).select("id", "r.*")


@query("s14_target_size", "WITH s AS (SELECT p_partkey AS id, p_size * 100 + 37 AS w, 1200 AS h FROM part), t AS (SELECT *, least(CAST(640 AS DOUBLE) / w, CAST(480 AS DOUBLE) / h) AS s FROM s) SELECT id, CAST(CASE WHEN s >= 1 THEN w ELSE least(w, greatest(1, floor(w * s + 0.5))) END AS BIGINT) AS tw, CAST(CASE WHEN s >= 1 THEN h ELSE least(h, greatest(1, floor(h * s + 0.5))) END AS BIGINT) AS th FROM t")
def s14(spark, sf):
    p = table(spark, sf, "part")
    t = K.target_size((F.col("p_size") * 100 + 37), F.lit(1200), 640, 480)
    return p.select(F.col("p_partkey").alias("id"), t.alias("t")).select("id", "t.*")


# ---- C: colour
@query("c1_rgba_to_rgb", f"WITH {RGBA8} SELECT * FROM pix WHERE c < 3")
def c1(spark, sf):
    return C.drop_alpha(rgba8(spark, sf))


@query("c2_rgb_to_rgba", f"WITH {RGBA8} SELECT image_id, y, x, c, CASE c WHEN 3 THEN 255 ELSE v END AS v FROM pix")
def c2(spark, sf):
    return C.add_alpha(C.drop_alpha(rgba8(spark, sf)))


_GRAY = f"WITH {WIDE} SELECT image_id, y, x, (77 * r + 150 * g + 29 * b) >> 8 AS v FROM w"


@query("c3_rgba_to_gray", _GRAY)
def c3(spark, sf):
    return C.to_gray(rgba8(spark, sf))


@query("c4_rgb_to_gray", _GRAY)
def c4(spark, sf):
    return C.to_gray(C.drop_alpha(rgba8(spark, sf)))


def _layout(name, sql_pos, position):
    @query(name, f"WITH {RGBA8}, p AS (SELECT image_id, {sql_pos} AS pos, v FROM pix) SELECT image_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS data FROM p GROUP BY image_id")
    def run(spark, sf):
        out = L.to_arrays(rgba8(spark, sf), position())
        return out.select("image_id", F.array_join(F.transform("data", lambda x: x.cast("string")), ",").alias("data"))


for _n in ("c5_hwc_to_chw", "c23_nhwc_to_nchw"):
    _layout(_n, "(c * 4 + y) * 4 + x", lambda: L.chw(4, 4))
for _n in ("c6_chw_to_hwc", "c24_nchw_to_nhwc"):
    _layout(_n, "(y * 4 + x) * 4 + c", lambda: L.hwc(4, 4))

_map("c7_gamma", lambda v: K.gamma(v, 2.2), "CASE WHEN v > 0 THEN pow(v, 1 / CAST(2.2 AS DOUBLE)) ELSE v END")
_map("c8_srgb_to_linear", lambda v: K.srgb_to_linear(v + 0.5), "CASE WHEN v + 0.5 <= 0.04045 THEN (v + 0.5) / 12.92 ELSE pow((v + 0.5 + 0.055) / 1.055, 2.4) END")
_map("c9_linear_to_srgb", lambda v: K.linear_to_srgb(v + 0.5), "CASE WHEN v + 0.5 <= 0.0031308 THEN (v + 0.5) * 12.92 ELSE 1.055 * pow(v + 0.5, 1 / CAST(2.4 AS DOUBLE)) - 0.055 END")


@query("c10_srgb_u8_to_linear", f"WITH {RGBA8} SELECT image_id, y, x, c, round(CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END, 6) AS v FROM pix")
def c10(spark, sf):
    return rgba8(spark, sf).withColumn("v", F.round(K.srgb_to_linear(F.col("v") / 255.0), 6))


@query("c11_linear_to_srgb_u8", f"WITH {RGBA32}, s AS (SELECT image_id, y, x, c, abs(v) AS v FROM pix) SELECT image_id, y, x, c, CAST(floor(least(255, round(255 * CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / CAST(2.4 AS DOUBLE)) - 0.055 END, 6)) + 0.5) AS BIGINT) AS v FROM s")
def c11(spark, sf):
    return rgba32(spark, sf).withColumn("v", L.as_u8(F.round(K.linear_to_srgb(F.abs("v")) * 255, 6)))


_HUE = "CASE WHEN mx = mn THEN 0 WHEN mx = r THEN ((g - b) / (mx - mn) + CASE WHEN g < b THEN 6 ELSE 0 END) / 6 WHEN mx = g THEN ((b - r) / (mx - mn) + 2) / 6 ELSE ((r - g) / (mx - mn) + 4) / 6 END"
_MM = f"{RGB}, m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM rgb)"


@query("c12_rgb_to_hsv", f"WITH {_MM} SELECT image_id, p, round({_HUE}, 6) AS h, round(CASE WHEN mx > 0 THEN (mx - mn) / mx ELSE 0 END, 6) AS s, round(mx, 6) AS v FROM m")
def c12(spark, sf):
    out = rgb(spark, sf).select("image_id", "p", K.rgb_to_hsv(*map(F.col, "rgb")).alias("k")).select("image_id", "p", "k.*")
    return rounded(out, "h", "s", "v")


@query("c14_rgb_to_hsl", f"WITH {_MM} SELECT image_id, p, round({_HUE}, 6) AS h, round(CASE WHEN mx = mn THEN 0 WHEN (mx + mn) / 2 > 0.5 THEN (mx - mn) / (2 - mx - mn) ELSE (mx - mn) / (mx + mn) END, 6) AS s, round((mx + mn) / 2, 6) AS l FROM m")
def c14(spark, sf):
    out = rgb(spark, sf).select("image_id", "p", K.rgb_to_hsl(*map(F.col, "rgb")).alias("k")).select("image_id", "p", "k.*")
    return rounded(out, "h", "s", "l")


_HSV = f"{RGB}, t AS (SELECT image_id, p, (r - floor(r)) * 6 AS hh, CAST(floor((r - floor(r)) * 6) AS INT) % 6 AS i, (r - floor(r)) * 6 - floor((r - floor(r)) * 6) AS f, g AS s, b AS v FROM rgb), u AS (SELECT *, v * (1 - s) AS k0, v * (1 - s * f) AS k1, v * (1 - s * (1 - f)) AS k2 FROM t)"


def _case(*names):
    return "CASE WHEN s <= 0 THEN v " + " ".join(f"WHEN i = {k} THEN {n}" for k, n in enumerate(names)) + " END"


@query("c13_hsv_to_rgb", f"WITH {_HSV} SELECT image_id, p, round({_case('v', 'k1', 'k0', 'k0', 'k2', 'v')}, 6) AS r, round({_case('k2', 'v', 'v', 'k1', 'k0', 'k0')}, 6) AS g, round({_case('k0', 'k0', 'k2', 'v', 'v', 'k1')}, 6) AS b FROM u")
def c13(spark, sf):
    out = rgb(spark, sf).select("image_id", "p", K.hsv_to_rgb(*map(F.col, "rgb")).alias("k")).select("image_id", "p", "k.*")
    return rounded(out, *"rgb")


def _hsl(shift):
    t = f"(h + {shift} - floor(h + {shift}))"
    return f"CASE WHEN s <= 0 THEN l WHEN {t} < 1 / 6.0::DOUBLE THEN pp + (q - pp) * 6 * {t} WHEN {t} < 0.5 THEN q WHEN {t} < 2 / 3.0::DOUBLE THEN pp + (q - pp) * (2 / 3.0::DOUBLE - {t}) * 6 ELSE pp END"


_HSL = f"{RGB}, t AS (SELECT image_id, p, r - floor(r) AS h, g AS s, least(greatest(b, 0), 1) AS l FROM rgb), u AS (SELECT *, CASE WHEN l < 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS q FROM t), w AS (SELECT *, 2 * l - q AS pp FROM u)"


@query("c15_hsl_to_rgb", f"WITH {_HSL} SELECT image_id, p, round({_hsl('1 / 3.0::DOUBLE')}, 6) AS r, round({_hsl('0')}, 6) AS g, round({_hsl('2 / 3.0::DOUBLE')}, 6) AS b FROM w")
def c15(spark, sf):
    light = F.least(F.greatest(F.col("b"), F.lit(0.0)), F.lit(1.0))
    out = rgb(spark, sf).select("image_id", "p", K.hsl_to_rgb(F.col("r"), F.col("g"), light).alias("k")).select("image_id", "p", "k.*")
    return rounded(out, *"rgb")


M34 = [[0.6, 0.3, 0.1, 0.05], [-0.2, 1.1, 0.1, -0.1], [0.0, 0.25, 0.75, 0.2]]


def _matrix(name, columns):
    row = lambda k: " + ".join(f"{w} * {c}" for w, c in zip(M34[k], "rgb")) + (f" + {M34[k][3]}" if columns == 4 else "")
    parts = " UNION ALL ".join(f"SELECT image_id, y, x, CAST({k} AS BIGINT) AS c, round({row(k) if k < 3 else 'a'}, 6) AS v FROM w" for k in range(4))
    wide = WIDE.replace(BYTE, "v")

    @query(name, f"WITH {wide} {parts}")
    def run(spark, sf):
        return rounded(C.color_matrix(rgba32(spark, sf), [r[:columns] for r in M34]), "v")


_matrix("c16_color_matrix_3x3", 3)
_matrix("c17_color_matrix_3x4", 4)


def _alpha(name, each, back):
    parts = " UNION ALL ".join(f"SELECT image_id, y, x, CAST({k} AS BIGINT) AS c, CAST({each.replace('$', c) if k < 3 else 'a'} AS BIGINT) AS v FROM w" for k, c in enumerate("rgba"))

    @query(name, f"WITH {WIDE} {parts}")
    def run(spark, sf):
        return G.premultiplied(rgba8(spark, sf), back)


_PRE, _UN = "($ * a + 127) // 255", "CASE WHEN a = 0 THEN 0 ELSE least(255, ($ * 255 + a // 2) // a) END"
_alpha("c18_premultiply", _PRE, False)
_alpha("c19_unpremultiply", _UN, True)


def _alpha_resize(to):
    tx, ty = _axis("tx", 4, to[0], "bilinear"), _axis("ty", 4, to[1], "bilinear")
    pre = " UNION ALL ".join(f"SELECT image_id, y, x, CAST({k} AS BIGINT) AS c, CAST({_PRE.replace('$', c) if k < 3 else 'a'} AS BIGINT) AS v FROM w" for k, c in enumerate("rgba"))
    wide = "w2 AS (SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) AS a FROM rs GROUP BY ALL)"
    post = " UNION ALL ".join(f"SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST({k} AS BIGINT) AS c, CAST({_UN.replace('$', c) if k < 3 else 'a'} AS BIGINT) AS v FROM w2" for k, c in enumerate("rgba"))
    return f"{WIDE}, {tx}, {ty}, pre AS ({pre}), rs AS ({_u8(_resampled('pre', 6))}), {wide}, done AS ({post})"


@query("c20_resize_alpha", f"WITH {_alpha_resize((3, 5))} SELECT * FROM done")
def c20(spark, sf):
    return G.resize_rgba8_alpha(rgba8(spark, sf), (4, 4), (3, 5))


@query("c21_letterbox_alpha", f"WITH {_alpha_resize(_RECT[2:])}, {_grid(7, 5, 4)} {_padded('SELECT * FROM done', _RECT[0], _RECT[1], [5, 6, 7, 0])}")
def c21(spark, sf):
    return G.letterbox_rgba8_alpha(rgba8(spark, sf), (4, 4), (7, 5), [5, 6, 7, 0])


@query("c22_u8_to_f32", f"WITH {RGBA8} SELECT image_id, (c * 4 + y) * 4 + x AS pos, round(v * (2 / CAST(255 AS DOUBLE)) - 1, 6) AS v FROM pix")
def c22(spark, sf):
    return rgba8(spark, sf).select("image_id", L.chw(4, 4).alias("pos"), F.round(C.u8_to_f32(F.col("v"), 2 / 255, -1.0), 6).alias("v"))


@query("c25_f32_to_u8", f"WITH {RGBA32} SELECT image_id, (y * 4 + x) * 4 + c AS pos, {BYTE} AS v FROM pix")
def c25(spark, sf):
    return rgba32(spark, sf).select("image_id", L.hwc(4, 4).alias("pos"), C.f32_to_u8(F.col("v"), 255.0, 127.5).alias("v"))


#: Fixed values, each preset's means and deviations of red, green and blue.
_CLIP = "(0, 0.48145466, 0.26862954), (1, 0.4578275, 0.26130258), (2, 0.40821073, 0.27577711)"
_IMAGENET = "(0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)"
_STATS = f"st AS (SELECT c, CAST(mean AS DOUBLE) AS mean, CAST(std AS DOUBLE) AS std FROM (VALUES {_CLIP}) AS t(c, mean, std))"


@query("c26_normalize", f"WITH {RGBA32}, {_STATS} SELECT image_id, y, x, pix.c, round((v - mean) / std, 6) AS v FROM pix JOIN st ON st.c = pix.c")
def c26(spark, sf):
    return rounded(C.normalize(rgba32(spark, sf), *C.PRESETS["clip"]), "v")


@query("c27_presets", " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(c AS BIGINT) AS c, CAST(mean AS DOUBLE) AS mean, CAST(std AS DOUBLE) AS std FROM (VALUES {v}) AS t(c, mean, std)" for n, v in (("clip", _CLIP), ("imagenet", _IMAGENET), ("sam", _IMAGENET))))
def c27(spark, sf):
    return C.presets(spark)


_FUSED = f"WITH {RGBA8.replace('v FROM fld)', 'v FROM fld)', 1)}, {_T43}, {_STATS}, r AS ({_u8(_resampled('pix', 6))}) SELECT image_id, CAST((r.c * 5 + y) * 3 + x AS BIGINT) AS pos, round((v / CAST(255 AS DOUBLE) - mean) / std, 6) AS v FROM r JOIN st ON st.c = r.c"


@query("c28_fused_preproc", _FUSED)
def c28(spark, sf):
    small = G.resize_u8(C.drop_alpha(rgba8(spark, sf)), (4, 4), (3, 5))
    out = C.normalize(small.withColumn("v", C.u8_to_f32(F.col("v"), 1 / 255)), *C.PRESETS["clip"])
    return rounded(out.select("image_id", L.chw(3, 5).cast("long").alias("pos"), "v"), "v")


@query("c29_tensor_normalize", f"WITH {RGBA32}, {_STATS}, n AS (SELECT image_id, (pix.c * 4 + y) * 4 + x AS pos, round((v - mean) / std, 4) AS v FROM pix JOIN st ON st.c = pix.c) SELECT image_id, count(*) AS n, round(sum(v), 4) AS total FROM n GROUP BY image_id")
def c29(spark, sf):
    out = rounded(C.normalize(C.drop_alpha(rgba32(spark, sf)), *C.PRESETS["clip"]), "v", digits=4)
    packed = L.to_arrays(out, L.chw(4, 4)).withColumn("ok", F.assert_true(F.size("data") == 48))
    return packed.where("ok is null").select("image_id", F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# ---- T: tiling (8x8 planes in tiles of 5 at steps of 3)
#: Tiles of 5 at steps of 3 over 8: from 0 and from 3, two places in common, where the window falls and rises as a cosine.
_AX = "ax AS (SELECT t, i, 3 * t + i AS p, CASE WHEN t = 1 AND i < 2 THEN 0.5 - 0.5 * cos(pi() * (i + 0.5) / 2) WHEN t = 0 AND i >= 3 THEN 0.5 - 0.5 * cos(pi() * (4 - i + 0.5) / 2) ELSE 1 END AS w FROM (SELECT CAST(unnest(range(2)) AS BIGINT) AS t), (SELECT CAST(unnest(range(5)) AS BIGINT) AS i))"


@query("t1_feather_window", "WITH a AS (SELECT CAST(unnest(range(6)) AS BIGINT) AS i), r AS (SELECT i, CASE WHEN i < 2 THEN 0.5 - 0.5 * cos(pi() * (i + 0.5) / 2) WHEN i >= 3 THEN 0.5 - 0.5 * cos(pi() * (5 - i + 0.5) / 3) ELSE 1 END AS w FROM a) SELECT q.i AS y, p.i AS x, round(p.w * q.w, 6) AS w FROM r p CROSS JOIN r q")
def t1(spark, sf):
    return rounded(spark.createDataFrame(T.feather_window(6, 6, 2, 3, 2, 3), "y long, x long, w double"), "w")


_SPLIT = f"WITH {PLANE}, {_AX}, tl AS (SELECT image_id, CAST(b.t AS BIGINT) AS ty, CAST(a.t AS BIGINT) AS tx, CAST(b.i AS BIGINT) AS y, CAST(a.i AS BIGINT) AS x, c, v, a.w * b.w AS w, a.p AS px, b.p AS py FROM pix JOIN ax a ON a.p = pix.x JOIN ax b ON b.p = pix.y)"


@query("t4_split", _SPLIT + " SELECT image_id, ty, tx, y, x, c, round(v, 6) AS v FROM tl")
def t4(spark, sf):
    return rounded(T.split(plane(spark, sf), 8, 8, 5, 3), "v")


@query("t2_accumulate", _SPLIT + " SELECT image_id, CAST(py AS BIGINT) AS y, CAST(px AS BIGINT) AS x, c, round(sum(v * w), 6) AS acc, round(sum(w), 6) AS weight FROM tl GROUP BY image_id, py, px, c")
def t2(spark, sf):
    return rounded(T.accumulate(T.split(plane(spark, sf), 8, 8, 5, 3), 8, 8, 5, 3), "acc", "weight")


@query("t3_normalize_accumulator", f"WITH {PLANE} SELECT image_id, y, x, c, round(v, 6) AS v FROM pix")
def t3(spark, sf):
    sums = T.accumulate(T.split(plane(spark, sf), 8, 8, 5, 3), 8, 8, 5, 3)
    return rounded(T.normalize_accumulator(sums), "v")


# ---- X: several images
def _pairs(pixels):
    a = pixels.where("image_id % 2 = 0").withColumn("image_id", F.floor(F.col("image_id") / 2))
    b = pixels.where("image_id % 2 = 1").withColumn("image_id", F.floor(F.col("image_id") / 2))
    return a, b


_CMP = f"WITH {RGBA8}, d AS (SELECT p.image_id // 2 AS image_id, p.y, p.x, p.y // 2 AS cell_y, p.x // 2 AS cell_x, sum(q.v - p.v) FILTER (p.c = 0) AS s0, sum((q.v - p.v) * (q.v - p.v)) AS sq, max(abs(q.v - p.v)) AS worst FROM pix p JOIN pix q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x AND q.c = p.c WHERE p.image_id % 2 = 0 GROUP BY ALL) SELECT image_id, coalesce(cell_y, -1) AS cell_y, coalesce(cell_x, -1) AS cell_x, round(avg(s0), 6) AS mean0, round(sqrt(sum(sq) / (count(*) * CAST(4 AS DOUBLE))), 6) AS rms, round(10 * log10(65025 / (sum(sq) / (count(*) * CAST(4 AS DOUBLE)))), 6) AS psnr, CAST(max(worst) AS BIGINT) AS max_abs, round(avg(CASE WHEN worst > 8 THEN 1 ELSE 0 END), 6) AS changed, count(*) AS pixels FROM d GROUP BY GROUPING SETS ((image_id, cell_y, cell_x), (image_id))"


@query("x1_compare", _CMP)
def x1(spark, sf):
    out = X.compare(*_pairs(rgba8(spark, sf)), 4, 4, 4, 2, 2)
    cell = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return rounded(out.select("image_id", cell("cell_y"), cell("cell_x"), "mean0", "rms", "psnr", "max_abs", "changed", "pixels"), "mean0", "rms", "psnr", "changed")


_SSIM = f"WITH {PLANE8}, s AS (SELECT p.image_id // 2 AS image_id, avg(p.v) AS a, avg(q.v) AS b, avg(p.v * p.v) AS aa, avg(q.v * q.v) AS bb, avg(p.v * q.v) AS ab FROM pix p JOIN pix q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.image_id % 2 = 0 GROUP BY 1) SELECT image_id, round((2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)), 6) AS ssim FROM s"


#: Windows of 8x8 at steps of 4 over 16x16 (four planes side by side), by the cell of 2x2 that holds the window's centre.
_TALL = f"WITH {PLANE8}, big AS (SELECT image_id // 8 AS image_id, image_id // 4 % 2 AS side, y + image_id % 4 // 2 * 8 AS y, x + image_id % 2 * 8 AS x, v FROM pix WHERE image_id // 8 * 8 + 7 <= (SELECT max(image_id) FROM pix))"
_CELL_SSIM = f"{_TALL}, s AS (SELECT p.image_id, wy, wx, avg(p.v) AS a, avg(q.v) AS b, avg(p.v * p.v) AS aa, avg(q.v * q.v) AS bb, avg(p.v * q.v) AS ab FROM big p JOIN big q ON p.side = 0 AND q.side = 1 AND q.image_id = p.image_id AND q.y = p.y AND q.x = p.x JOIN (SELECT unnest([0, 4, 8]) AS wy) ON p.y BETWEEN wy AND wy + 7 JOIN (SELECT unnest([0, 4, 8]) AS wx) ON p.x BETWEEN wx AND wx + 7 GROUP BY ALL) SELECT image_id, CAST((wy + 4) // 8 AS BIGINT) AS cell_y, CAST((wx + 4) // 8 AS BIGINT) AS cell_x, round(avg((2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225))), 6) AS ssim FROM s GROUP BY ALL"


@query("x2_ssim_cells", _CELL_SSIM)
def x2c(spark, sf):
    p = plane8(spark, sf)
    i, last = F.col("image_id"), table(spark, sf, "embeddings").agg(F.max("vec_id").alias("last"))
    big = p.select(F.floor(i / 8).alias("image_id"), (F.floor(i / 4) % 2).alias("side"), (F.col("y") + F.floor(i % 4 / 2) * 8).alias("y"), (F.col("x") + i % 2 * 8).alias("x"), "v")
    big = big.join(F.broadcast(last), F.col("image_id") * 8 + 7 <= F.col("last")).drop("last")  # one row
    a, b = (big.where(F.col("side") == k).drop("side") for k in (0, 1))
    return rounded(X.ssim_cells(a, b, 16, 16, 2, 2), "ssim")


@query("x2_ssim", _SSIM)
def x2(spark, sf):
    return rounded(X.ssim(*_pairs(plane8(spark, sf).drop("c")), 8, 8), "ssim")


def _at(dy, dx):
    return f"max(q.v) FILTER (q.y = p.y + {dy} AND q.x = p.x + {dx})"


_SHARP = f"WITH {PLANE8}, n AS (SELECT p.image_id, p.y, p.x, p.v, 4 * p.v - {_at(0, -1)} - {_at(0, 1)} - {_at(-1, 0)} - {_at(1, 0)} AS lap, {_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)} AS gx, {_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)} AS gy FROM pix p JOIN pix q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY p.image_id, p.y, p.x, p.v), s AS (SELECT image_id, var_pop(lap) AS laplacian_variance, avg(gx * gx + gy * gy) AS tenengrad, avg(v) AS luma_mean, stddev_pop(v) AS luma_std, count(*) AS pixels FROM n GROUP BY image_id)"


@query("x3_sharpness", _SHARP + " SELECT image_id, round(laplacian_variance, 4) AS laplacian_variance, round(tenengrad, 4) AS tenengrad, round(luma_mean, 4) AS luma_mean, round(luma_std, 4) AS luma_std, pixels FROM s")
def x3(spark, sf):
    return rounded(X.sharpness(plane8(spark, sf)), "laplacian_variance", "tenengrad", "luma_mean", "luma_std", digits=4)


@query("x4_sharpest", _SHARP + ", r AS (SELECT label, image_id, laplacian_variance AS k, row_number() OVER (PARTITION BY label ORDER BY laplacian_variance DESC, image_id) AS n FROM s JOIN embeddings ON vec_id = image_id) SELECT label, image_id, round(k, 4) AS laplacian_variance FROM r WHERE n = 1")
def x4(spark, sf):
    s = X.sharpness(plane8(spark, sf)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label"), "image_id")
    return rounded(X.sharpest(s, "label"), "laplacian_variance", digits=4)


@query("x5_motion_luma", f"WITH {WIDE}, l AS (SELECT image_id, y, x, (54 * r + 183 * g + 19 * b) >> 8 AS v FROM w) SELECT image_id, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) + 2) >> 2 AS v FROM l GROUP BY ALL")
def x5(spark, sf):
    luma = C.weigh_channels(rgba8(spark, sf), [54, 183, 19]).select("image_id", "y", "x", F.shiftright("s", 8).alias("v"))
    return X.half_u8(luma, 4, 4)


_COARSE = f"WITH {PLANE8}, sh AS (SELECT u, v FROM (SELECT CAST(unnest(range(-2, 3)) AS BIGINT) AS u) CROSS JOIN (SELECT CAST(unnest(range(-2, 3)) AS BIGINT) AS v)), k AS (SELECT p.image_id // 2 AS image_id, sh.u, sh.v, CAST(sum((p.v - q.v) * (p.v - q.v)) AS BIGINT) + 2 * (abs(sh.u) + abs(sh.v)) AS cost FROM pix p CROSS JOIN sh JOIN pix q ON q.image_id = p.image_id + 1 AND q.y = p.y + sh.v AND q.x = p.x + sh.u WHERE p.image_id % 2 = 0 AND p.y BETWEEN 2 AND 5 AND p.x BETWEEN 2 AND 5 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cost, v, u) AS n FROM k) SELECT image_id, CAST(0 AS BIGINT) AS \"by\", CAST(0 AS BIGINT) AS bx, u, v, cost FROM r WHERE n = 1"


@query("x6_coarse_motion", _COARSE)
def x6(spark, sf):
    return X.coarse_motion(*_pairs(plane8(spark, sf).drop("c")), 8, 8, 1, 1, 4, 8, 2)


def _texture(x, y):
    return np.sin(x * 0.11 + y * 0.04) * 42 + np.sin(y * 0.14 - x * 0.05) * 38 + np.sin(x * 0.33 + y * 0.27) * 22 + np.sin(y * 0.45 - x * 0.38) * 14 + 128


def _frame_pairs(rows, n, dx, dy):
    """rows (pair_id) with two frames of n x n from one formula, other for each pair, the second moved by dx, dy.

    Made in Arrow batches, some MB at a time: sines in lambdas of Columns took as long as the operators.
    """

    def frames(ids, mx, my):
        at = lambda o: (np.arange(n) + o[:, None]).astype(float)
        v = _texture(at(ids * 5 - mx)[:, None, :], at(ids * 3 - my)[:, :, None])
        return list(np.floor(np.clip(v, 0, 255) + 0.5).astype(np.int32).reshape(len(ids), -1))

    def run(batches):
        some = max(1, 2**18 // (n * n))
        for f in batches:
            for k in range(0, len(f), some):
                ids, mx, my = f[k : k + some].to_numpy(np.int64).T
                yield pd.DataFrame({"pair_id": ids, "width": n, "a": frames(ids, 0 * mx, 0 * my), "b": frames(ids, mx, my)})

    return rows.select("pair_id", dx.cast("long").alias("dx"), dy.cast("long").alias("dy")).mapInPandas(run, "pair_id long, width int, a array<int>, b array<int>")


def _nations(spark, sf):
    """A pair a nation, moved by up to three pixels each way."""
    k = F.col("pair_id")
    return _frame_pairs(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pair_id")), 128, k % 7 - 3, k % 5 - 2)


@query("x6_block_motion", "SELECT CAST(n_nationkey AS BIGINT) AS pair_id, CAST(i // 4 AS BIGINT) AS \"by\", CAST(i % 4 AS BIGINT) AS bx, CAST(n_nationkey % 7 - 3 AS BIGINT) AS dx, CAST(n_nationkey % 5 - 2 AS BIGINT) AS dy, CAST(0 AS BIGINT) AS status FROM nation, (SELECT unnest(range(16)) AS i)")
def x6b(spark, sf):
    """Each block moves as its pair does, to the nearest pixel."""
    m = X.block_motion(_nations(spark, sf), radius=4)
    return m.select("pair_id", "by", "bx", F.round("dx").cast("long").alias("dx"), F.round("dy").cast("long").alias("dy"), "status")


@query("x7_block_residual", "SELECT CAST(n_nationkey AS BIGINT) AS pair_id, CAST(i // 4 AS BIGINT) AS \"by\", CAST(i % 4 AS BIGINT) AS bx, n_nationkey % 2 = 1 AS new FROM nation, (SELECT unnest(range(16)) AS i)")
def x7(spark, sf):
    """Planes of half size of which, for odd pairs, the second is a pattern that no motion explains."""
    pairs = _nations(spark, sf)
    half = lambda c: F.transform(F.sequence(F.lit(0), F.lit(64 * 64 - 1)), lambda p: F.floor(sum(F.element_at(c, (F.floor(p / 64) * 256 + p % 64 * 2 + k + 1).cast("int")) for k in (0, 1, 128, 129)) / 4 + 0.5).cast("int"))
    odd = F.transform(F.col("half_b"), lambda v, p: F.when((F.floor(p / 128) + p % 64 / 2).cast("int") % 2 == 0, 20).otherwise(230))
    pairs = pairs.withColumns({"half_a": half("a"), "half_b": half("b")}).withColumn("half_b", F.when(F.col("pair_id") % 2 == 1, odd).otherwise(F.col("half_b")))
    return X.residual_rows(pairs, radius=4).select("pair_id", "by", "bx", (F.col("residual") > 5).alias("new"))


@query("x8_align", "SELECT vec_id AS pair_id, CAST(vec_id % 5 - 2 AS BIGINT) AS tx, CAST(vec_id % 3 - 1 AS BIGINT) AS ty, CAST(100 AS BIGINT) AS scale, CAST(0 AS BIGINT) AS rotation, true AS converged FROM embeddings")
def x8(spark, sf):
    """A pair an embedding, moved by up to two pixels each way."""
    k = F.col("pair_id")
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pair_id"))
    ids = ids.repartition(max(32, 3 * spark.sparkContext.defaultParallelism), "pair_id")  # the work is in the pairs, not in the bytes read
    t = _frame_pairs(ids, 48, k % 5 - 2, k % 3 - 1)
    unit = lambda c: F.transform(c, lambda v: v / 255.0)
    got = X.align_similarity(t.select("pair_id", "width", unit("a").alias("ref"), unit("b").alias("mov")), search=2)
    whole = lambda c, k: F.round(F.col(c) * k).cast("long").alias(c)
    return got.select("pair_id", whole("tx", 1), whole("ty", 1), whole("scale", 100), whole("rotation", 100), "converged")


_NCC = f"WITH {PLANE} SELECT p.image_id // 2 AS image_id, round(sqrt(avg((q.v - p.v) * (q.v - p.v))), 6) AS rms, round(corr(p.v, q.v), 6) AS ncc, CAST(1 AS DOUBLE) AS coverage FROM pix p JOIN pix q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.image_id % 2 = 0 GROUP BY 1"


@query("x9_measure", _NCC)
def x9(spark, sf):
    a, b = _pairs(plane(spark, sf).drop("c"))
    pairs = a.withColumnRenamed("v", "r").join(L.sorted_join(b.withColumnRenamed("v", "m")), ["image_id", "y", "x"])
    return rounded(X.measure(pairs), "rms", "ncc")


@query("x10_pyramid_half", f"WITH {PLANE} SELECT image_id, y // 2 AS y, x // 2 AS x, round(avg(v), 6) AS v FROM pix GROUP BY image_id, y // 2, x // 2")
def x10(spark, sf):
    return rounded(X.half_f32(plane(spark, sf), 8, 8), "v")


@query("x10_mask_half", f"WITH {PLANE} SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(CASE WHEN count(*) FILTER (v > 0) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS v FROM pix GROUP BY image_id, y // 2, x // 2")
def x10m(spark, sf):
    return X.half_mask(plane(spark, sf).withColumn("v", (F.col("v") > 0).cast("int")), 8, 8)


def _slope(axis):
    other = "y" if axis == "x" else "x"
    j = lambda d: f"q.{other} = p.{other} AND q.{axis} = {d}"
    return f"(max(q.v) FILTER ({j(f'least(p.{axis} + 1, 7)')}) - max(q.v) FILTER ({j(f'greatest(p.{axis} - 1, 0)')})) / (least(p.{axis} + 1, 7) - greatest(p.{axis} - 1, 0))"


@query("x10_gradients", f"WITH {PLANE} SELECT p.image_id, p.y, p.x, round({_slope('x')}, 6) AS gx, round({_slope('y')}, 6) AS gy FROM pix p JOIN pix q ON q.image_id = p.image_id AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.image_id, p.y, p.x")
def x10g(spark, sf):
    return rounded(X.gradients(plane(spark, sf)), "gx", "gy")


# ---- the flagship: bytes, resize, normalize, statistics of each label
_FLAG = f"WITH {RGBA8}, {_T43}, {_STATS}, r AS ({_u8(_resampled('pix', 6))}) SELECT label, CAST(r.c AS BIGINT) AS c, count(*) AS n, round(avg((v / CAST(255 AS DOUBLE) - mean) / std), 6) AS mean FROM r JOIN st ON st.c = r.c JOIN embeddings ON vec_id = image_id GROUP BY label, r.c"


@query("flagship_preproc_stats", _FLAG)
def flagship(spark, sf):
    small = G.resize_u8(C.drop_alpha(rgba8(spark, sf)), (4, 4), (3, 5))
    out = C.normalize(small.withColumn("v", C.u8_to_f32(F.col("v"), 1 / 255)), *C.PRESETS["clip"])
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return out.join(labels, "image_id").groupBy("label", "c").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
