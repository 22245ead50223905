"""Exact percentiles without one task holding a whole group.

Spark's exact ``percentile`` merges a value -> count map per group in one task,
which is unbounded for large groups of continuous values.  One path serves
groups of every size:

1. the keyed values are written once; every later step reads that table;
2. per group: the row count, and ``percentile_approx`` bounds a margin below
   and above each probability, computed once and written;
3. per group and probability: the rows below the band, and the nearest values
   outside it, in one partial aggregate; the band's rows are counted per
   distinct value, at most about ``4 n / accuracy`` values a band;
4. bands of more than ``BAND_ROWS`` rows are narrowed, pass by pass: quantiles of the band's own rows split
   it, exact counts tell which part holds the wanted ranks, and that part is the next band.  A part
   is one value or the rows between two neighbouring split values, so bands shrink about 64-fold a pass;
5. a running count over the band's values picks the order statistics, and the
   result interpolates like Spark's ``percentile``:
   ``(higher - pos) * v_lo + (pos - lower) * v_hi`` with ``pos = p (n - 1)``.

The margin ``2 / accuracy`` covers the sketch's rank error (``n / accuracy``).
In groups below ``accuracy`` rows the sketch is exact, and a bound can be off
by the one rank between ``p n`` and ``p (n - 1)``: the nearest value outside
the band is then the order statistic.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvspark.session import cut_lineage

DEFAULT_ACCURACY = 10_000
BAND_ROWS = 1_000_000     # rows of a band that one task may order
SPLITS = 63               # split values of a band in a pass


def exact_percentiles(df: DataFrame, group_cols: list[str], value: str, probs: list[float],
                      names: list[str] | None = None, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``group_cols`` + one column per probability; groups without values are absent."""
    names = names or [f"p{i}" for i in range(len(probs))]
    g = list(group_cols)
    key = g if g else ["_one"]
    d = df.select(*g, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not g:
        d = d.withColumn("_one", F.lit(1))
    d = cut_lineage(d)
    margin = 2.0 / accuracy
    bounds = [b for p in probs for b in (max(0.0, p - margin), min(1.0, p + margin))]
    st = cut_lineage(d.groupBy(*key).agg(F.count("*").alias("_n"), F.percentile_approx("_v", bounds, accuracy).alias("_b")))
    lo, hi = (lambda i: F.col("_b")[2 * i]), (lambda i: F.col("_b")[2 * i + 1])
    v, every = F.col("_v"), range(len(probs))

    def joined(bounds: DataFrame) -> DataFrame:
        return _same_key(d, bounds, key, ["_v"], [c for c in bounds.columns if c not in key])

    def around(bounds: DataFrame) -> DataFrame:
        return joined(bounds).groupBy(*key).agg(*[a for i in every for a in (
            F.count_if(v < lo(i)).alias(f"_below{i}"), F.max(F.when(v < lo(i), v)).alias(f"_prev{i}"),
            F.min(F.when(v > hi(i), v)).alias(f"_next{i}"),
            F.count_if((v >= lo(i)) & (v <= hi(i)) & (lo(i) < hi(i))).alias(f"_in{i}"))])

    outside = around(st)
    if (st.agg(F.max("_n")).first()[0] or 0) > BAND_ROWS:  # else no band can be wider
        st = st.withColumn("_settled", F.array().cast("array<int>"))
        while True:
            outside = cut_lineage(around(st))
            open_ = [F.when(~F.array_contains("_settled", i), F.col(f"_in{i}")) for i in every]
            widest = _same_key(outside, st, key, [f"_in{i}" for i in every], ["_settled"]).agg(*map(F.max, open_)).first()
            if max((x or 0) for x in widest) <= BAND_ROWS:
                break
            st = cut_lineage(_narrowed(joined, st, outside, key, probs))
    rows = joined(st)
    within = [(v >= lo(i)) & (v <= hi(i)) for i in every]
    inside = F.array_compact(F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(within)]))
    # most rows are in no band: they are dropped before the array is made
    band = rows.where(reduce(or_, within)).select(*key, "_n", "_v", F.explode(inside).alias("_i")).groupBy(*key, "_n", "_i", "_v").agg(
        F.count("*").alias("_c"))
    w = Window.partitionBy(*key, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    band = band.withColumn("_cum", F.sum("_c").over(w))
    both = _same_key(band, outside, key, ["_n", "_i", "_v", "_cum"],
                     [f"_{x}{i}" for i in every for x in ("below", "prev", "next")])
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        reached = F.col(f"_below{i}") + F.col("_cum")
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.min(F.when((F.col("_i") == i) & (reached > rank), F.col("_v"))).alias(f"_{side}{i}"))
        aggs += [F.max(f"_{x}{i}").alias(f"_{x}{i}") for x in ("below", "prev", "next")]
    picked = both.groupBy(*key, "_n").agg(*aggs)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        r0, r1 = F.floor(pos), F.ceil(pos)
        a, b = (F.when(r < F.col(f"_below{i}"), F.col(f"_prev{i}")).otherwise(
            F.coalesce(F.col(f"_{side}{i}"), F.col(f"_next{i}"))) for side, r in (("lo", r0), ("hi", r1)))
        out.append(F.when((r0 == r1) | (a == b), a).otherwise((r1 - pos) * a + (pos - r0) * b).alias(name))
    return picked.select(*g, *out)


def _same_key(left: DataFrame, right: DataFrame, key: list[str], of_left: list[str], of_right: list[str]) -> DataFrame:
    """Inner join on the key, null-safe: a null group is a group."""
    return left.alias("l").join(right.alias("r"), _on(key)).select(
        *[F.col(f"l.{k}") for k in key], *[F.col(f"l.{c}") for c in of_left], *[F.col(f"r.{c}") for c in of_right])


def _narrowed(joined, bounds: DataFrame, outside: DataFrame, key: list[str], probs: list[float]) -> DataFrame:
    """``bounds`` with every band above ``BAND_ROWS`` rows cut down to the part that holds its wanted ranks.

    ``_settled`` lists the probabilities whose two ranks lie in different parts, which leaves two values, or
    in a part of a single value.
    """
    every = range(len(probs))
    sized = _same_key(bounds, outside, key, ["_n", "_b", "_settled"], [f"_{x}{i}" for x in ("below", "in") for i in every])
    wide = sized.select(*key, "_n", F.explode(F.array_compact(F.array(*[
        F.when((F.col(f"_in{i}") > BAND_ROWS) & ~F.array_contains("_settled", i),
               F.struct(F.lit(i).alias("_i"), F.col("_b")[2 * i].alias("_lo"), F.col("_b")[2 * i + 1].alias("_hi"),
                        F.col(f"_below{i}").alias("_below"))) for i in every]))).alias("_w")).select(*key, "_n", "_w.*")
    band = _same_key(joined(bounds).select(*key, "_v"), wide, key, ["_v"], ["_n", "_i", "_lo", "_hi", "_below"]).where(
        (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    grid = [(j + 1) / (SPLITS + 1) for j in range(SPLITS)]
    at = [*key, "_i"]
    splits = cut_lineage(band.groupBy(*at).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", grid, DEFAULT_ACCURACY))).alias("_s")))
    parts = _same_key(band, splits, at, ["_v", "_n", "_below"], ["_s"])
    # odd: a split value itself; even: the values between two of them
    part = 2 * F.size(F.filter("_s", lambda x: x < F.col("_v"))) + F.array_contains("_s", F.col("_v")).cast("int")
    parts = parts.select(*at, "_n", "_below", "_v", part.alias("_part")).groupBy(*at, "_n", "_below", "_part").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    w = Window.partitionBy(*at).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1) * (F.col("_n") - 1)
    parts = parts.withColumn("_cum", F.col("_below") + F.sum("_c").over(w))
    first = [F.min_by(F.struct("_part", "_least", "_most"), F.when(F.col("_cum") > r, F.col("_part"))) for r in (F.floor(pos), F.ceil(pos))]
    # a rank right behind the band is found by the next value outside, as before
    found = parts.groupBy(*at).agg(first[0].alias("_f"), F.coalesce(first[1], first[0]).alias("_g"))
    one = F.col("_f._part") == F.col("_g._part")
    cut = F.struct("_i", F.when(one, F.col("_f._least")).otherwise(F.col("_f._most")).alias("_lo"),
                   F.when(one, F.col("_g._most")).otherwise(F.col("_g._least")).alias("_hi"), F.coalesce(~one, F.lit(True)).alias("_two"))
    cuts = found.groupBy(*key).agg(F.collect_list(cut).alias("_cuts"))  # one a probability at most
    def cut_of(i: int):
        return F.get(F.filter("_cuts", lambda c: c["_i"] == i), F.lit(0))

    two = F.transform(F.filter("_cuts", lambda c: c["_two"]), lambda c: c["_i"])
    return bounds.alias("l").join(cuts.alias("r"), _on(key), "left").select(
        *[F.col(f"l.{k}") for k in key], F.col("l._n"),
        F.array(*[F.coalesce(cut_of(i)[side], F.col("l._b")[2 * i + k])
                  for i in every for k, side in enumerate(("_lo", "_hi"))]).alias("_b"),
        F.array_union(F.col("l._settled"), F.coalesce(two, F.array().cast("array<int>"))).alias("_settled"))


def _on(key: list[str]):
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return on
