"""Analytics over histories, telemetry, usage and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows that are last by the given columns."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest_of_each(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The last n rows of each key, with their rank. Spark keeps n rows a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def utility_priors(rows: DataFrame, name: str, actual: Column, saved: Column, duration: Column) -> DataFrame:
    """Mean utility of each pass, from the measured one or else from what it saved a millisecond."""
    utility = F.coalesce(actual, F.when(duration > 0, saved / duration).otherwise(0.0))
    return rows.groupBy(name).agg(F.avg(utility).alias("avg_utility"), F.avg(duration).alias("avg_duration"), F.count("*").alias("n"))


def index_percentile(values: Column, p: float) -> Column:
    """The value at round(p * (n - 1)) of the sorted values of a group."""
    at = F.round(F.lit(p) * (F.count(values) - 1)).cast("int") + 1
    return F.element_at(F.sort_array(F.collect_list(values)), at)


def zero_filled_days(daily: DataFrame, day: str, last: str, n: int) -> DataFrame:
    """daily (one row a day) on a spine of the n days that end with `last`; missing values are 0."""
    spine = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(last)), n - 1), F.to_date(F.lit(last)))).alias(day))
    return spine.join(daily, day, "left").fillna(0)


def override(base: DataFrame, disabled: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """base without disabled keys, own values winning."""
    kept = base.join(disabled, key, "left_anti").select(key, F.col(value).alias("base_value"))
    return kept.join(own.select(key, F.col(value).alias("own_value")), key, "full_outer").select(key, F.coalesce("own_value", "base_value").alias(value))


def accumulate(table: DataFrame, more: DataFrame, key: str, amount: str) -> DataFrame:
    """Upsert that adds amounts."""
    return table.select(key, amount).unionByName(more.select(key, amount)).groupBy(key).agg(F.sum(amount).alias(amount))


def replace(table: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Upsert in which new rows win; the key ignores case."""
    both = table.withColumn("newer", F.lit(0)).unionByName(more.withColumn("newer", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lower(key)).orderBy(F.desc("newer"), F.desc(key)))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank", "newer")


def insert_absent(table: DataFrame, more: DataFrame, key: str) -> DataFrame:
    return table.unionByName(more.join(table, key, "left_anti"))


def evict(phrases: DataFrame, owner: str, n: int, *order: str) -> DataFrame:
    """Each owner's n best phrases."""
    return latest_of_each(phrases, owner, n, *order).drop("rank")


def reaped(jobs: DataFrame, state: Column, age: Column, limits: dict[str, float]) -> DataFrame:
    """status: failed where a state has lasted longer than its limit, else as it was."""
    stale = F.lit(False)
    for name, limit in limits.items():
        stale = stale | ((state == name) & (age > limit))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(state))


def windowed_count(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """For each row, the rows of its key in the seconds up to it."""
    frame = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(1 - seconds * 1_000_000, 0)
    return rows.withColumn("n", F.count("*").over(frame))


def pareto(rows: DataFrame, more: list[str], less: list[str]) -> DataFrame:
    """Rows that no other beats: one that is as good in every column and better in one. rows are a small
    aggregate, a row a kind, which is broadcast only if Spark finds it small."""
    a, b = rows.alias("a"), rows.alias("b")
    as_good = [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in more] + [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in less]
    better = [F.col(f"b.{c}") > F.col(f"a.{c}") for c in more] + [F.col(f"b.{c}") < F.col(f"a.{c}") for c in less]
    every, some = F.lit(True), F.lit(False)
    for x in as_good:
        every = every & x
    for x in better:
        some = some | x
    return a.join(b, every & some, "left_anti")


def grouped_percentile(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """keys and value: the value at floor(n * p) of each group's sorted ones, from counts of each value, so
    that a group's rows never meet in one place."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return upto.groupBy(*keys).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(value))).alias("value"))


def weighted_mean(rows: DataFrame, key: Column, value: str, weight: str) -> DataFrame:
    """The key, n, and the mean of the values by weight; null where the weights add up to nothing."""
    total = F.sum(weight)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).alias("weighted"))


def in_flight(rows: DataFrame, key: str, item: str, start: Column, end: Column) -> DataFrame:
    """key, item, slots: how many of the key's rows run when a row starts, itself included, each from its
    start up to its end.

    Starts and ends are events in one order, so the count is a running sum and no two rows are joined."""
    begins = rows.select(key, item, start.alias("at"), F.lit(1).alias("kind"))
    ends = rows.select(key, F.lit(None).cast(dict(rows.dtypes)[item]).alias(item), end.alias("at"), F.lit(-1).alias("kind"))
    w = Window.partitionBy(key).orderBy("at")  # by range: all events of one time count together
    both = begins.unionByName(ends).withColumn("slots", F.sum("kind").over(w))
    return both.where("kind = 1").select(key, item, "slots")
