"""Running totals, carried values, row numbers and quantiles over an order, without a window or group
that holds all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverlens.session import saved

#: Ranges that an order is cut into; each is one window, and the driver holds so many numbers.
RANGES = 64
#: Steps of the sketch that narrows a quantile down, and its relative error in ranks (1 / ERROR).
STEPS, ERROR = 200, 4000


def _range_of(df: DataFrame, order: str) -> Column:
    """The number of the range that holds a row, by approximate quantiles of the order."""
    cuts = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.002)))
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: c < F.col(order)))


def _same(keys, renamed) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed, strict=True)]


def running(df: DataFrame, order: str, values, keys=()) -> DataFrame:
    """df with below_<v> for each value: its sum over the rows of the same keys that come before in
    order. df has one row for each key and place in the order, a number. It is worked out once;
    approximate quantiles cut the order into ranges, whose totals (a row for each key and range) and
    windows inside of them give the exact sums."""
    df = saved(df, "running")
    d = df.withColumn("_run_range", _range_of(df, order))
    per = d.groupBy(*keys, "_run_range").agg(*(F.sum(v).alias(f"_run_{v}") for v in values))
    before = Window.partitionBy(*keys).orderBy("_run_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [f"_run_key{i}" for i in range(len(keys))]
    ends = per.select(*(F.col(k).alias(r) for k, r in zip(keys, named, strict=True)), F.col("_run_range").alias("_run_of"), *(F.coalesce(F.sum(f"_run_{v}").over(before), F.lit(0)).alias(f"_run_{v}") for v in values))
    inside = Window.partitionBy(*keys, "_run_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    j = d.withColumns({f"below_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(ends, [*_same(keys, named), F.col("_run_range") == F.col("_run_of")])
    return j.select(*df.columns, *((F.col(f"below_{v}") + F.col(f"_run_{v}")).alias(f"below_{v}") for v in values))


def carried(df: DataFrame, order: str, value: str, before: str, after: str, keys=()) -> DataFrame:
    """df with the last value that is not null at or before each place in the order, and the first at or
    after it, among the rows of the same keys. Each range of the order is a window of its own; what
    the ranges before and after it end or begin with (a row for each key and range) is scanned and
    joined to it, across any number of ranges without a value."""
    df = saved(df, "carried")
    d = df.withColumn("_car_range", _range_of(df, order))
    known = F.col(value).isNotNull()
    ends = d.groupBy(*keys, "_car_range").agg(F.max_by(value, F.when(known, F.col(order))).alias("_car_last"), F.min_by(value, F.when(known, F.col(order))).alias("_car_first"))
    scan = Window.partitionBy(*keys).orderBy("_car_range")
    named = [f"_car_key{i}" for i in range(len(keys))]
    ends = ends.select(
        *(F.col(k).alias(r) for k, r in zip(keys, named, strict=True)), F.col("_car_range").alias("_car_of"),
        F.last("_car_last", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("_car_last"),
        F.first("_car_first", ignorenulls=True).over(scan.rowsBetween(1, Window.unboundedFollowing)).alias("_car_first"),
    )
    own = Window.partitionBy(*keys, "_car_range").orderBy(order)
    d = d.withColumns({
        "_car_b": F.last(value, ignorenulls=True).over(own.rangeBetween(Window.unboundedPreceding, 0)),
        "_car_a": F.first(value, ignorenulls=True).over(own.rangeBetween(0, Window.unboundedFollowing)),
    })
    j = d.join(ends, [*_same(keys, named), F.col("_car_range") == F.col("_car_of")])
    return j.select(*df.columns, F.coalesce("_car_b", "_car_last").alias(before), F.coalesce("_car_a", "_car_first").alias(after))


def numbered(df: DataFrame, order, name: str = "number") -> DataFrame:
    """df with consecutive numbers from 0 in a total order of its rows: sorted by ranges, counted range
    by range, numbered inside of each. The driver holds a count for each range."""
    d = saved(df.repartitionByRange(*order).withColumn("_num_range", F.spark_partition_id()), "numbered")
    counts = {r["_num_range"]: r["count"] for r in d.groupBy("_num_range").count().collect()}
    start, at = {}, 0
    for k in sorted(counts):
        start[k], at = at, at + counts[k]
    own = F.row_number().over(Window.partitionBy("_num_range").orderBy(*order))
    first = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))[F.col("_num_range")] if start else F.lit(0)
    return d.withColumn(name, (own - 1 + first).cast("long")).drop("_num_range")


def shuffled(number: Column, n: int, seed: int, rounds: int = 6, steps: int = 64) -> Column:
    """A seeded bijection of the numbers 0..n-1: a Feistel network on pairs (left, right) of about
    sqrt(n) values each. What falls past n is dealt on until it doesn't (cycle walking); the pairs
    are fewer than n + 2 sqrt(n), so `steps` never run out in practice, and raise an error if they do."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def dealt(k: int):
        def change(x: Column) -> Column:
            left, right = F.floor(x / b), x % b
            if k % 2:
                right = (right + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), left), F.lit(b))) % b
            else:
                left = (left + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), right), F.lit(a))) % a
            return left * b + right

        return change

    def once(x: Column) -> Column:
        for k in range(rounds):  # each number is bound once, so that the expression grows with the rounds only
            x = F.transform(F.array(x), dealt(k))[0]
        return x

    start = F.struct(number.cast("long").alias("x"), F.lit(False).alias("done"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(once(s["x"])), lambda y: F.struct(y.alias("x"), (y < n).alias("done")))[0]))
    return F.transform(F.array(walk), lambda s: F.when(s["done"], s["x"]).otherwise(F.raise_error(F.lit("no number found"))))[0].cast("long")


def quantiles(df: DataFrame, value: str, qs, keys=()) -> DataFrame:
    """keys and an array `quantiles` of the exact quantiles qs of a value, linear between ranks; null
    values don't count. A mergeable sketch brackets each quantile between two values; the second pass
    counts what is below the bracket and keeps the distinct values inside of it with their counts, a
    few steps' worth of the rows, whose ranks then come from running totals."""
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_q_v"))
    grid = [i / STEPS for i in range(STEPS + 1)]
    sketch = d.groupBy(*keys).agg(F.count("*").alias("_q_n"), F.percentile_approx("_q_v", grid, ERROR).alias("_q_grid")).where("_q_n > 0")
    slack = 1.5 / ERROR
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)))).alias("_q_e")
    rank = F.col("_q_e.q") * (F.col("_q_n") - 1)
    below = F.floor((F.floor(rank) / F.col("_q_n") - slack) * STEPS).cast("int")
    above = F.ceil(((F.floor(rank) + 2) / F.col("_q_n") + slack) * STEPS).cast("int")
    named = [f"_q_key{i}" for i in range(len(keys))]
    b = sketch.select(*keys, "_q_n", "_q_grid", each).select(
        *(F.col(k).alias(r) for k, r in zip(keys, named, strict=True)), F.col("_q_e.i").alias("_q_i"), rank.alias("_q_rank"),
        F.when(below > 0, F.col("_q_grid")[below]).otherwise(F.lit(float("-inf"))).alias("_q_lo"),
        F.when(above < STEPS, F.col("_q_grid")[above]).otherwise(F.lit(float("nan"))).alias("_q_hi"),  # NaN is the greatest
    )
    if keys:
        j = d.join(saved(b, "brackets"), _same(keys, named))
    else:  # one bracket for each of qs, which the driver holds
        known = [F.struct(*(F.lit(r[c]).alias(c) for c in b.columns)) for r in b.collect()]
        j = d.select("*", F.inline(F.array(*known))) if known else d.crossJoin(b)
    j = j.where("_q_v <= _q_hi")
    # all that is below a bracket counts as one value there
    at = F.when(F.col("_q_v") < F.col("_q_lo"), F.lit(float("-inf"))).otherwise(F.col("_q_v"))
    per = j.groupBy(*named, "_q_i", "_q_rank", at.alias("_q_at")).agg(F.count("*").alias("_q_c"))
    r = running(per, "_q_at", ["_q_c"], (*named, "_q_i"))
    k = F.floor("_q_rank")
    holds = lambda x: (F.col("below__q_c") <= x) & (x < F.col("below__q_c") + F.col("_q_c"))
    v = r.groupBy(*named, "_q_i", "_q_rank").agg(F.max(F.when(holds(k), F.col("_q_at"))).alias("a"), F.max(F.when(holds(k + 1), F.col("_q_at"))).alias("b"))
    v = v.withColumn("v", F.col("a") + F.coalesce((F.col("b") - F.col("a")) * (F.col("_q_rank") - k), F.lit(0.0)))
    out = v.groupBy(*named).agg(F.array_sort(F.collect_list(F.struct("_q_i", "v"))).alias("l")).where(F.size("l") > 0)
    return out.select(*(F.col(r).alias(k) for k, r in zip(keys, named, strict=True)), F.col("l.v").alias("quantiles"))
