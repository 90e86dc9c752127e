"""Running values over series of any length, by DataFrame operations, without a task or a row that holds a series.

Rows are dealt by key and period (``period_of``, or any long that ascends with the order). Within a period, values run
in a window of its own; one row a period has what the period adds up to, and what was before it is carried from period
to period and joined back. A hot key is so spread over as many tasks as it has periods.

``prefixes`` has products, sums, counts, greatest and last values, and the row before. ``affine`` has recursions
e = a * e + x, whose stretches compose: any stretch is a map (a, b), and maps are put together in a tree of ``FAN``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Maps that become one in each level of the tree, and levels above the periods: with three, up to 262144 periods.
FAN, LEVELS = 64, 3
#: Within a stretch, weights fall by no more than this factor, so dividing by them loses next to no precision.
STEEPEST = math.log(1e4)


def period_of(dt: str = "dt", days: int = 64) -> Column:
    """The number of a date's period of ``days`` days; from the year 1 on, none is below zero."""
    return F.floor((F.datediff(F.col(dt), F.lit("1970-01-01").cast("date")) + 719_163) / days).cast("long")


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])


def prefixes(df: DataFrame, keys: list[str], order: list[str], period: Column, running: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running values over each key's rows up to and including each one. ``running`` says of each new column
    what it is and of which column: product, sum, max, last (the last that is not null), count (of those that are not
    null), or previous (the value one row before, null or not). ``df`` is read twice and should be a written table.
    """
    rows = df.withColumn("_p", period)
    mine = [*keys, "_p"]
    within = Window.partitionBy(*mine).orderBy(*order)
    upto, earlier = within.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    local, total, before, both = {}, [], [], []
    for out, (kind, c) in running.items():
        x, here, ahead = F.col(c), F.col(f"r._l_{out}"), F.col(f"b._b_{out}")
        if kind == "product":
            local[out], t, b, v = F.product(x).over(upto), F.product(x), F.product(F.col(f"_t_{out}")).over(earlier), F.coalesce(here * ahead, here, ahead)
        elif kind == "sum":
            local[out], t, b, v = F.sum(x).over(upto), F.sum(x), F.sum(f"_t_{out}").over(earlier), F.coalesce(here + ahead, here, ahead)
        elif kind == "count":
            local[out], t, b, v = F.count(x).over(upto), F.count(x), F.sum(f"_t_{out}").over(earlier), here + F.coalesce(ahead, F.lit(0))
        elif kind == "max":
            local[out], t, b, v = F.max(x).over(upto), F.max(x), F.max(f"_t_{out}").over(earlier), F.greatest(here, ahead)
        elif kind == "last":
            local[out], t = F.last(x, ignorenulls=True).over(upto), F.max_by(x, F.when(x.isNotNull(), at))
            b, v = F.last(f"_t_{out}", ignorenulls=True).over(earlier), F.coalesce(here, ahead)
        elif kind == "previous":
            local[out], t = F.lag(F.struct(x.alias("v"))).over(within), F.max_by(F.struct(x.alias("v")), at)
            b, v = F.last(f"_t_{out}", ignorenulls=True).over(earlier), F.coalesce(here, ahead)["v"]
        else:
            raise ValueError(f"unknown kind of running value: {kind}")
        total.append(t.alias(f"_t_{out}"))
        before.append(b.alias(f"_b_{out}"))
        both.append(v.alias(out))
    carried = rows.groupBy(*mine).agg(*total).select(*mine, *before)
    ran = rows.select("*", *(c.alias(f"_l_{out}") for out, c in local.items()))
    kept = [c for c in df.columns if c not in running]
    return ran.alias("r").join(carried.alias("b"), _same("r", "b", mine), "left").select(*(F.col(f"r.{c}").alias(c) for c in kept), *both)


def _step(acc: Column, m: Column, count: int) -> Column:
    return F.struct(*((m[f"a{i}"] * acc[f"e{i}"] + m[f"b{i}"]).alias(f"e{i}") for i in range(count)))


def _carried(maps: DataFrame, keys: list[str], levels: list[tuple[str, Column | None]], count: int) -> DataFrame:
    """(keys, ids, e0, ...): the values before each map. ``levels`` names the maps' id and that of the group that it lies
    in, up to the last, which has none. Maps have columns a and b for each value, and s: its first value."""
    at, group = levels[0]
    parents = [levels[1][0]] if len(levels) > 1 else []
    if group is not None and parents[0] not in maps.columns:
        maps = maps.withColumn(parents[0], group)
    fields = [f"{x}{i}" for x in "abs" for i in range(count)]
    sets = maps.groupBy(*keys, *parents).agg(F.array_sort(F.collect_list(F.struct(at, *fields))).alias("m"))
    first = F.get("m", F.lit(0))
    if parents:
        one = F.struct(*(c for i in range(count) for c in (F.lit(1.0).alias(f"a{i}"), F.lit(0.0).alias(f"b{i}"))))

        def then(acc: Column, m: Column) -> Column:
            each = [((m[f"a{i}"] * acc[f"a{i}"]).alias(f"a{i}"), (m[f"a{i}"] * acc[f"b{i}"] + m[f"b{i}"]).alias(f"b{i}")) for i in range(count)]
            return F.struct(*(c for pair in each for c in pair))

        whole = F.aggregate("m", one, then)
        above = sets.select(*keys, *parents, whole.alias("w"), first.alias("f")).select(*keys, *parents, "w.*", *(F.col(f"f.s{i}").alias(f"s{i}") for i in range(count)))
        before = _carried(above, keys, levels[1:], count)
        both = sets.alias("r").join(before.alias("b"), _same("r", "b", [*keys, *parents]))
        sets = both.select(*(F.col(f"r.{c}").alias(c) for c in (*keys, *parents, "m")), F.struct(*(F.col(f"b.e{i}").alias(f"e{i}") for i in range(count))).alias("e"))
    else:
        sets = sets.withColumn("e", F.struct(*(first[f"s{i}"].alias(f"e{i}") for i in range(count))))
    each = F.transform("m", lambda m, i: F.struct(m[at].alias(at), F.aggregate(F.slice("m", F.lit(1), i), F.col("e"), lambda acc, x: _step(acc, x, count)).alias("e")))
    return sets.select(*keys, *parents, F.explode(each).alias("x")).select(*keys, *parents, f"x.{at}", "x.e.*")


def affine(df: DataFrame, keys: list[str], order: list[str], period: Column, values: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """``df`` with values that each follow from the one before: e = a * e + x in each key's order. ``values`` gives of each
    new column a (0 to 1), x, and the value before the key's first row, which is taken there. A row whose a or x is null
    changes nothing.

    Rows of a period are cut into stretches over which no product of a falls below 1e-4. Within one, a row's value is a
    sum in a window; the stretch as a whole is a map of what comes before it. A period should have some hundreds of
    stretches at most."""
    count, mine = len(values), [*keys, "_p"]
    rows = df.withColumn("_p", period)
    for i, (a, x, start) in enumerate(values.values()):
        known = a.isNotNull() & x.isNotNull()
        rows = rows.withColumns({f"_a{i}": F.when(known, a).otherwise(1.0), f"_x{i}": F.when(known, x).otherwise(0.0), f"_s{i}": start})
    fall = F.greatest(*(-F.log(F.greatest(f"_a{i}", F.lit(1e-300))) for i in range(count))) if count > 1 else -F.log(F.greatest("_a0", F.lit(1e-300)))
    inside = Window.partitionBy(*mine).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.floor(F.sum(fall).over(inside) / STEEPEST))
    stretch = Window.partitionBy(*mine, "_c").orderBy(*order)
    upto = stretch.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.row_number().over(stretch))
    rows = rows.withColumns({f"_q{i}": F.product(F.when(F.col("_n") == 1, 1.0).otherwise(F.col(f"_a{i}"))).over(upto) for i in range(count)})
    sums = {f"_b{i}": F.col(f"_q{i}") * F.sum(F.col(f"_x{i}") / F.col(f"_q{i}")).over(upto) for i in range(count)}
    rows = rows.withColumns(sums | {f"_w{i}": F.col(f"_q{i}") * F.first(f"_a{i}").over(upto) for i in range(count)})
    rows = written(rows.drop("_n", *(f"_{x}{i}" for x in "axq" for i in range(count))), "scan")

    at = F.struct(*order)
    ends = rows.groupBy(*mine, "_c").agg(
        *(F.max_by(f"_w{i}", at).alias(f"a{i}") for i in range(count)), *(F.max_by(f"_b{i}", at).alias(f"b{i}") for i in range(count)), *(F.min_by(f"_s{i}", at).alias(f"s{i}") for i in range(count))
    )
    levels: list[tuple[str, Column | None]] = [("_c", None), *((f"_p{k or ''}", F.floor(F.col(f"_p{k or ''}") / FAN)) for k in range(LEVELS - 1)), (f"_p{LEVELS - 1}", None)]
    before = _carried(written(ends, "maps"), keys, levels, count)
    found = [(F.col(f"r._w{i}") * F.col(f"b.e{i}") + F.col(f"r._b{i}")).alias(out) for i, out in enumerate(values)]
    kept = [c for c in df.columns if c not in values]
    return rows.alias("r").join(before.alias("b"), _same("r", "b", [*mine, "_c"])).select(*(F.col(f"r.{c}").alias(c) for c in kept), *found)
