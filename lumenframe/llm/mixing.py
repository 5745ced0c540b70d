"""Mixing sources to target weights by entropy balancing.

Of all ways to give documents rates whose tokens add up to each constraint's target,
entropy balancing takes that nearest to the present tokens (least relative
entropy). Its rates are exponentially tilted, exp(sum of the multipliers of the
constraints that hold the document), and the multipliers solve a convex dual
problem, sum(tokens * rate) - multipliers . targets, by Newton iterations.
`balance` takes any constraints, also such that overlap: documents are first added
up by the set of constraints that holds them, and an iteration aggregates gradient
and Hessian from those sums. The mixture of sources has one constraint a source, so the
Hessian is diagonal and an iteration is one expression over the table of sources,
which Spark aggregates from the documents.

Rates become whole copies: floor(rate) and, for the rest, systematic rounding along
the source's documents ordered by class of size. What a source is then off by is
evened out by documents taken once more or less: first large ones (over 0.2 % of
the target; two of each class and bucket at most), from the largest on, each that
brings the source nearer its target; then small ones in order, as far as they fit. Everything is DataFrame expressions.

Targets: the wanted shares of all tokens, but at most `cap` times what a source
has; what is above goes to the others by weight, until none is above.

Defined results: a null or empty text has size 0 and is taken 0 words. A null
source is a source of its own and comes last. Null ids are ordered first, texts
that tie in id and size by their hash. Repeated rows are each mixed. A source without
words has target 0. An empty table gives an empty one. Extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, named, ranked, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float, rounds: int = 1000) -> DataFrame:
    """sources (source, source_size, weight) with target: weights' shares of all tokens, at most cap * source_size.

    Each round fixes the sources whose share is above their cap and deals what is
    left to the others by weight; a round is one aggregate of one row.
    """
    most = F.col("source_size") * F.lit(float(cap))
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, rest, capped = float(total or 0), float(weights or 0), F.lit(False)
    for _ in range(rounds):
        capped = F.col("weight") * F.lit(left) / F.lit(rest) >= most if rest else F.lit(True)
        fixed, free = sources.agg(F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        now = (float(total or 0) - fixed, float(free))
        if now == (left, rest) or not free:
            left, rest = now
            break
        left, rest = now
    else:
        raise RuntimeError(f"no level of the targets after {rounds} rounds")
    share = F.col("weight") * F.lit(left) / F.lit(rest) if rest else most
    return sources.withColumn("target", F.when(capped, most).otherwise(F.least(share, most)).cast("double"))


def newton(sources: DataFrame, tolerance: float = 1e-13, rounds: int = 200) -> DataFrame:
    """sources with multiplier: the root of source_size * exp(multiplier) = target.

    Each round is one damped Newton step for all sources at once; every eight an
    aggregate says how far the worst constraint is off.
    """
    s = sources.withColumn("multiplier", F.lit(0.0))
    for _ in range(0, rounds, 8):
        for _ in range(8):
            tokens = F.col("source_size") * F.exp("multiplier")
            step = F.when(F.col("target") > 0, (F.col("target") - tokens) / tokens).otherwise(F.lit(0.0))
            s = s.withColumn("multiplier", F.col("multiplier") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
        s = cut(s)
        off = s.where("target > 0").agg(F.max(F.abs(F.col("source_size") * F.exp("multiplier") / F.col("target") - 1))).first()[0]
        if off is None or off <= tolerance:
            return s
    raise RuntimeError(f"the multipliers are still off by {off} after {rounds} steps")


def balance(df: DataFrame, size: Column, constraints: Column, targets: dict[str, float], tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """df with `rate`: the entropy-balancing rate of each row.

    constraints: the array of the names of the constraints that hold a row (null:
    none); targets: the tokens each named constraint is to have, above 0. Rows in no
    named constraint keep rate 1. Fails where no rates meet the targets. The driver
    holds targets' gradient and Hessian only.
    """
    names = sorted(targets)
    known = F.array_sort(F.array_distinct(F.filter(F.coalesce(constraints, F.array().cast("array<string>")), lambda x: x.isin(names))))
    rows = df.withColumn("_in", known)
    cells = cut(rows.where(F.size("_in") > 0).groupBy("_in").agg(F.sum(size).cast("double").alias("tokens")).where("tokens > 0"))
    at, x = {n: i for i, n in enumerate(names)}, np.zeros(len(names))

    def tilt(x: np.ndarray) -> Column:
        of = F.create_map(*[F.lit(v) for n in names for v in (n, float(x[at[n]]))]) if names else F.create_map().cast("map<string,double>")
        return F.exp(F.aggregate("_in", F.lit(0.0), lambda a, n: a + of[n]))

    def dual(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        now = cells.withColumn("t", F.col("tokens") * tilt(x))
        pairs = now.select("t", F.explode("_in").alias("a"), "_in").select("t", "a", F.explode("_in").alias("b")).groupBy("a", "b").agg(F.sum("t").alias("t"))
        h = np.zeros((len(names), len(names)))
        for r in pairs.collect():
            h[at[r["a"]], at[r["b"]]] = r["t"]
        total = now.agg(F.coalesce(F.sum("t"), F.lit(0.0))).first()[0]
        want = np.array([float(targets[n]) for n in names])
        return total - float(x @ want), h.diagonal() - want, h

    if names:
        value, g, h = dual(x)
        for _ in range(rounds):
            if np.abs(g).max() <= tolerance * max(targets.values()):
                break
            step = np.linalg.lstsq(h, g, rcond=1e-12)[0]
            scale = 1.0
            while True:  # halved until the dual falls
                new = dual(x - scale * step)
                if np.isfinite(new[0]) and new[0] <= value + 1e-12 * abs(value) or scale < 1e-6:
                    break
                scale /= 2
            x, (value, g, h) = x - scale * step, new
        if np.abs(g).max() > max(tolerance, 1e-6) * max(targets.values()):
            raise RuntimeError("no rates meet the targets")
    return rows.withColumn("rate", tilt(x)).drop("_in")


#: Documents of up to this share of a source's target even out in order what the larger ones leave.
FINE = 0.002
#: Larger ones of a class and bucket that may do so.
LARGE = 2


def _keyed(df: DataFrame) -> DataFrame:
    """Groups of a source by class of size and by bucket of id and size: keys without nulls, the same for windows and joins."""
    key = F.when(F.col("_source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("_source").cast("string")))
    bucket = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("_doc").cast("string"), F.lit("")), F.lit("/"), F.col("_size").cast("string")).cast("binary")), 1, 2), 16, 10).cast("int")
    return df.withColumns({"_key": key, "_class": F.length(F.bin("_size")), "_bucket": bucket})


_GROUP = ["_key", "_class", "_bucket"]


def _rounded(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with _copies by systematic rounding: the k-th document gets floor(f k + 1/2) - floor(f (k - 1) + 1/2) of the fraction f."""
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy("_size", "_doc", "_tie"))
    out = docs.withColumn("_place", place).join(groups, _GROUP)
    whole = F.floor("_rate")
    rest, k = F.col("_rate") - whole, F.col("_before") + F.col("_place")
    extra = F.floor(rest * k + 0.5) - F.floor(rest * (k - 1) + 0.5)
    return out.withColumn("_copies", F.when(F.col("_size") > 0, (whole + extra).cast("long")).otherwise(F.lit(0).cast("long")))


def _movable(up: Column, cap: float) -> Column:
    """Whether a document may be taken once more (or, if not up, once less)."""
    return (F.col("_size") > 0) & F.when(up, F.col("_copies") + 1 <= F.lit(cap)).otherwise(F.col("_copies") > 0)


def _is_fine() -> Column:
    return F.col("_size") <= F.col("_target") * FINE


def _fine(up: Column, cap: float) -> Column:
    """Words of the small documents that may be taken once more or less."""
    return F.when(_is_fine() & _movable(up, cap), F.col("_size")).otherwise(F.lit(0).cast("long"))


def _greedy(large: DataFrame) -> DataFrame:
    """For each source (_key, _off) the large documents to change, from the largest on, each that brings the source nearer: (_key, _rest, took)."""
    empty = F.array().cast("array<struct<_class:int,_bucket:int,_place:int,_by:int>>")
    listed = large.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("_size")).alias("s"), "_class", "_bucket", "_place", "_up", "_down"))).alias("l"), F.first("_off").alias("_off"))

    def step(acc: Column, x: Column) -> Column:
        def changed(by: int) -> Column:
            one = F.struct(x["_class"].alias("_class"), x["_bucket"].alias("_bucket"), x["_place"].alias("_place"), F.lit(by).alias("_by"))
            return F.struct((acc["left"] + x["s"] * by).alias("left"), F.concat(acc["took"], F.array(one)).alias("took"))

        nearer = -x["s"] < 2 * F.abs(acc["left"])
        return F.when(nearer & (acc["left"] > 0) & x["_up"], changed(1)).when(nearer & (acc["left"] < 0) & x["_down"], changed(-1)).otherwise(acc)

    done = listed.withColumn("d", F.aggregate("l", F.struct("_off", empty.alias("took")).cast("struct<left:bigint,took:array<struct<_class:int,_bucket:int,_place:int,_by:int>>>"), step))
    return done.select("_key", F.col("d.left").alias("_rest"), F.col("d.took").alias("took"))


def solve(docs: DataFrame, weights: Column | None, cap: float) -> DataFrame:
    """One row for each group of docs (_source, _doc, _size, _tie): its source's target and rate, and what precedes it there."""
    per = docs.groupBy("_key", F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    placed = ranked(per, [F.col("source").asc_nulls_last()], "_rank")
    weighed = cut(placed.withColumn("weight", (F.col("_rank") % 3 + 1 if weights is None else weights).cast("double")).drop("_rank"))
    solved = newton(water_fill(weighed, cap))
    rate = F.when(F.col("target") > 0, F.least(F.lit(float(cap)), F.round(F.exp("multiplier"), 12))).otherwise(F.lit(0.0))
    solved = solved.select("_key", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), rate.alias("_rate"))

    def before(column: str, *order: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    counts = docs.groupBy(*_GROUP).agg(F.count("*").alias("_n"))
    groups = cut(counts.withColumn("_before", before("_n", "_class", "_bucket")).drop("_n").join(solved, "_key"))
    rounded = _rounded(docs, groups)
    up, down = F.lit(True), F.lit(False)
    big = (F.col("_place") <= LARGE) & ~_is_fine() & (F.col("_size") > 0)
    some = F.collect_list(F.when(big, F.struct("_size", F.col("_place").cast("int").alias("_place"), _movable(up, cap).alias("_up"), _movable(down, cap).alias("_down"))))  # at most LARGE
    sums = rounded.groupBy(*_GROUP).agg(F.sum(F.col("_size") * F.col("_copies")).alias("_taken"), F.sum(_fine(up, cap)).alias("_more"), F.sum(_fine(down, cap)).alias("_less"), some.alias("_large"))
    off = (F.round("_target").cast("long") - F.sum("_taken").over(Window.partitionBy("_key"))).alias("_off")
    sums = cut(groups.join(sums, _GROUP).select(*groups.columns, "_more", "_less", "_large", off))
    large = sums.select(*_GROUP, "_off", F.explode("_large").alias("x")).select(*_GROUP, "_off", "x.*")
    moved = cut(_greedy(large))
    took = moved.select("_key", F.explode("took").alias("x")).groupBy("_key", "x._class", "x._bucket").agg(F.map_from_entries(F.collect_list(F.struct("x._place", "x._by"))).alias("_chosen"))
    sums = sums.join(moved.select("_key", "_rest"), "_key", "left").join(took, _GROUP, "left")
    sums = sums.withColumn("_rest", F.coalesce("_rest", "_off")).withColumn("_adjust", F.when(F.col("_rest") > 0, F.col("_more")).otherwise(F.col("_less")))
    return cut(sums.withColumn("_adjusted", before("_adjust", "_bucket", "_class")).drop("_more", "_less", "_large", "_adjust", "_off"))


def apply_copies(docs: DataFrame, groups: DataFrame, cap: float) -> DataFrame:
    """docs with _copies: rounded, then the chosen large and the first fine documents once more or less until the source fits."""
    out = _rounded(docs, groups).withColumn("_fine", _fine(F.col("_rest") > 0, cap))
    upto = F.sum("_fine").over(Window.partitionBy(*_GROUP).orderBy("_size", "_doc", "_tie").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_adjusted")
    small = F.when((F.col("_fine") > 0) & (upto <= F.abs("_rest")), F.signum("_rest").cast("long")).otherwise(F.lit(0).cast("long"))
    large = F.coalesce(F.try_element_at("_chosen", F.col("_place").cast("int")), F.lit(0))
    return out.withColumn("_copies", F.col("_copies") + small + large)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"))
    docs = cut(_keyed(docs))
    out = apply_copies(docs, solve(docs, None, 3.0), 3.0)
    return out.select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Column | None = None, cap: float = 3.0) -> DataFrame:
    """The mixture itself: each row of df as often as it is taken, with df's columns.

    weights: a Column over `_rank`, the source's place (from 0) by code point,
    null last; by default 1, 2, 3, repeating. Rates are solved on ids, sources
    and sizes; the texts move once, to their groups.
    """
    row = F.struct(*[named(c) for c in df.columns]).alias("_row")
    keyed = _keyed(df.select(row, named(id_col).alias("_doc"), named(source_col).alias("_source"), word_count(named(text_col)).alias("_size"), F.xxhash64(named(text_col)).alias("_tie")))
    groups = solve(cut(keyed.drop("_row")), weights, cap)
    out = apply_copies(keyed, groups, cap).where("_copies > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_n")).select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), fill AS (
  SELECT 0 AS step, source, source_size, w, CAST(NULL AS DOUBLE) AS fixed FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w,
    CASE WHEN fixed IS NOT NULL THEN fixed
         WHEN w * (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) / sum(CASE WHEN fixed IS NULL THEN w ELSE 0 END) OVER () >= 3.0 * source_size THEN 3.0 * source_size END
  FROM fill WHERE step < 60
), t AS (
  SELECT source, source_size,
    coalesce(fixed, w * (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) / sum(CASE WHEN fixed IS NULL THEN w ELSE 0 END) OVER ()) AS target
  FROM fill WHERE step = 60
), k AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, length(bin(d.size)) AS class,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '/' || CAST(d.size AS VARCHAR)), 1, 2) AS INTEGER) AS bucket,
    CASE WHEN t.target > 0 THEN round(least(3.0, t.target / t.source_size), 12) ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS FIRST) AS n,
    row_number() OVER (PARTITION BY source, class, bucket ORDER BY size, doc_id NULLS FIRST) AS place FROM k
), c AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(rate) + floor((rate - floor(rate)) * n + 0.5) - floor((rate - floor(rate)) * (n - 1) + 0.5) AS BIGINT) ELSE 0 END AS copies FROM r
), o AS (
  SELECT *, CAST(round(target) AS BIGINT) - CAST(sum(size * copies) OVER (PARTITION BY source) AS BIGINT) AS off FROM c
), m AS (
  SELECT *, copies + 1 <= 3 AS up, copies > 0 AS down, size <= target * 0.002 AS small FROM o
), b AS (
  SELECT source, class, bucket, place, size, off, up, down, row_number() OVER (PARTITION BY source ORDER BY size DESC, class, bucket, place) AS i
  FROM m WHERE size > 0 AND NOT small AND place <= 2
), g AS (
  SELECT source, CAST(0 AS BIGINT) AS i, max(off) AS rest, CAST(0 AS BIGINT) AS way FROM b GROUP BY source
  UNION ALL
  SELECT source, i, rest - way * size, way FROM (
    SELECT b.source, b.i, g.rest, b.size, CAST(CASE WHEN b.size < 2 * abs(g.rest) AND CASE WHEN g.rest > 0 THEN b.up ELSE b.down END THEN sign(g.rest) ELSE 0 END AS BIGINT) AS way
    FROM g JOIN b ON b.source IS NOT DISTINCT FROM g.source AND b.i = g.i + 1)
), v AS (
  SELECT b.source, b.class, b.bucket, b.place, g.way, g.way * b.size AS moved FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source AND b.i = g.i WHERE g.way <> 0
), h AS (
  SELECT m.*, coalesce(v.way, 0) AS way, off - coalesce(sum(v.moved) OVER (PARTITION BY m.source), 0) AS rest
  FROM m LEFT JOIN v ON v.source IS NOT DISTINCT FROM m.source AND v.class = m.class AND v.bucket = m.bucket AND v.place = m.place
), f AS (
  SELECT *, CASE WHEN small AND CASE WHEN rest > 0 THEN up ELSE down END THEN size ELSE 0 END AS fine FROM h
), u AS (
  SELECT *, sum(fine) OVER (PARTITION BY source ORDER BY bucket, class, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + way + CASE WHEN fine > 0 AND upto <= abs(rest) THEN sign(rest) ELSE 0 END) AS BIGINT) AS taken
FROM u
"""

QUERIES = {"op10_mix": op10_mix}
ORACLES = {"op10_mix": ORACLE}
