"""Corpus statistics (family D) and orderings, top-k and set operations (family G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_total(df: DataFrame, key: str, *aggs: Column, total: str = "Total") -> DataFrame:
    """Aggregates by key and in all, in one pass (rollup). A null key is its own group, not the total."""
    return df.rollup(key).agg(*aggs, F.grouping(key).alias("__g")).withColumn(key, F.when(F.col("__g") == 1, total).otherwise(F.col(key))).drop("__g")


def describe(c: Column, name: str) -> list[Column]:
    """D3: mean, median, least, greatest and population deviation."""
    return [F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"), F.stddev_pop(c).alias(f"std_{name}")]


def frequencies(df: DataFrame, *keys: str, k: int | None = None, count: str = "n") -> DataFrame:
    """Counts, most frequent first, ties by key; the first ``k`` if given."""
    out = df.groupBy(*keys).agg(F.count("*").alias(count)).orderBy(F.desc(count), *keys)
    return out if k is None else out.limit(k)


def repeated(df: DataFrame, *keys: str, count: str = "n") -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def shares(df: DataFrame, value: str, out: str = "percent") -> DataFrame:
    """The percentage of the total, through a one-row aggregate (no single-partition window)."""
    total = df.agg(F.sum(value).alias("__t"))
    return df.join(F.broadcast(total)).withColumn(out, F.col(value) * 100.0 / F.col("__t")).drop("__t")


def floor_percent(condition: Column) -> Column:
    """The percentage of rows that fulfil a condition, rounded down; an aggregate."""
    return F.floor(F.count_if(condition) * 100 / F.count("*")).cast("bigint")


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of ``col`` values by ``row``, with column percentages; null for an empty column."""
    counts = df.groupBy(row).agg(*(F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values))
    totals = counts.agg(*(F.sum(f"n_{v}").alias(f"t_{v}") for v in values))
    return counts.join(F.broadcast(totals)).select(row, *(x for v in values for x in (F.col(f"n_{v}"), F.try_divide(F.col(f"n_{v}") * 100.0, F.col(f"t_{v}")).alias(f"p_{v}"))))


def element_counts(df: DataFrame, array: str, element: str = "element") -> DataFrame:
    """Rows that hold each element, and their share of all rows."""
    total = df.agg(F.count("*").alias("total"))
    n = df.select(F.explode(F.array_distinct(array)).alias(element)).groupBy(element).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select(element, "n", (F.col("n") / F.col("total")).alias("share"))


def membership_counts(df: DataFrame, array: str, a: str, b: str) -> DataFrame:
    """Rows that hold one element, the other, and both."""
    x, y = F.array_contains(array, a), F.array_contains(array, b)
    return df.agg(F.count_if(x).alias("n_a"), F.count_if(y).alias("n_b"), F.count_if(x & y).alias("n_both"))


def count_ifs(df: DataFrame, **conditions: Column) -> DataFrame:
    """One count for each condition, one pass."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def histogram(df: DataFrame, value: str, bins: int = 20, lo: float = 0.0, hi: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Equal bins; the last one is closed. Empty bins are not listed."""
    b = F.least(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n"))


def frequency_cdf(df: DataFrame, key: str, up_to: int = 8) -> DataFrame:
    """The share of distinct keys that occur at most x times, x = 1 to ``up_to``."""
    sizes = df.groupBy(key).agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    total = sizes.agg(F.sum("k").alias("t"))
    x = df.sparkSession.range(1, up_to + 1).select(F.col("id").cast("int").alias("x"))
    return x.join(F.broadcast(sizes.where(F.col("c") <= up_to)), F.col("c") <= F.col("x"), "left").groupBy("x").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).join(F.broadcast(total)).select("x", (F.col("k") / F.col("t")).alias("share"))


def reciprocal_frequency(df: DataFrame, key: str) -> DataFrame:
    """The curve of 1/frequency over all mentions, as steps: (frequency, y, from_x, to_x), x scaled to 0..1.

    Mentions of one frequency share y, so the curve has a row per frequency, not per mention: the window
    runs over the few distinct frequencies.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("frequency")).groupBy("frequency").agg((F.count("*") * F.col("frequency")).alias("m"))
    w = Window.orderBy("frequency")
    upto, total = F.sum("m").over(w), F.sum("m").over(Window.partitionBy())
    scale = F.greatest(total - 1, F.lit(1))
    return sizes.select("frequency", (F.lit(1.0) / F.col("frequency")).alias("y"), ((upto - F.col("m")) / scale).alias("from_x"), ((upto - 1) / scale).alias("to_x"))


def by_value_set(df: DataFrame, group: str, value: str, out: str = "values") -> DataFrame:
    """Groups of rows under the sorted set of their values, counted by that set."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def mean_over_time(df: DataFrame, date: str, value: str) -> DataFrame:
    """D28."""
    return df.groupBy(date).agg(F.avg(value).alias(f"mean_{value}")).orderBy(date)


def label_vocabulary(df: DataFrame, array: str) -> DataFrame:
    """The distinct labels of an array column, sorted, with ids from 0 (labels are few: one array)."""
    labels = df.select(F.explode(array).alias("l")).agg(F.array_sort(F.collect_set("l")).alias("v"))
    return labels.select(F.posexplode("v").alias("label_id", "label"))


def weighted_average(df: DataFrame, value: str, weight: str | None) -> Column:
    """An aggregate: weighted if a weight is named."""
    return F.avg(value) if weight is None else F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """G1: the first ``k`` rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def wide(df: DataFrame, keys: list[str], rank: str, value: str, k: int, prefix: str = "id_", fill: str = "-") -> DataFrame:
    """Ranked values as ``k`` columns from rank 1, gaps filled."""
    aggs = [F.coalesce(F.max(F.when(F.col(rank) == i + 1, F.col(value).cast("string"))), F.lit(fill)).alias(f"{prefix}{i}") for i in range(k)]
    return df.groupBy(*keys).agg(*aggs)


def head(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first rows of an order (a tail is the head of the reversed order)."""
    return df.orderBy(*order).limit(n)


def union_all(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """Tables one above the other with the name of each."""
    return reduce(DataFrame.unionByName, [d.withColumn(name, F.lit(k)) for k, d in parts.items()])


def venn(flagged: DataFrame, names: list[str]) -> DataFrame:
    """The number of keys in each region, from one row per key with 0/1 flags."""
    return flagged.groupBy(*names).agg(F.count("*").alias("n"))


def later_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that repeat an earlier row's keys."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n > 1").drop("__n")


def cumulative_distinct(df: DataFrame, date: str, key: list[str], out: str = "cumulative") -> DataFrame:
    """Distinct keys seen up to each date; dates without new keys stay.

    Two aggregates do the work; the running sum goes over one row per date.
    """
    dates = df.select(date).distinct()
    new = df.groupBy(*key).agg(F.min(date).alias(date)).groupBy(date).agg(F.count("*").alias("__n"))
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return dates.join(new, date, "left").select(date, F.sum(F.coalesce("__n", F.lit(0))).over(w).alias(out))


def report(parts: dict[str, DataFrame], metric: str, value: str) -> DataFrame:
    """Metrics as rows, datasets as columns."""
    return union_all(parts).groupBy(metric).pivot("dataset", list(parts)).agg(F.first(value))


def export_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Rows under folders by key values."""
    df.write.mode("overwrite").partitionBy(*keys).json(path)
