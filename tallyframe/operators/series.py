"""Ordered logs: average ranks, moving means, marginal efficiency, markers, checkpoints.

Every window takes ``by`` columns (a run, a model); logs of different runs are independent partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str], descending: bool = True) -> Column:
    """Rank with ties averaged."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2


def moving_average(value: str, on: str, by: list[str], before: int, after: int = 0, full: bool = False) -> Column:
    """Mean over rows from ``before`` earlier to ``after`` later, nulls ignored; ``full``: only when all exist."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(-before, after)
    mean = F.avg(value).over(w)
    return F.when(F.count(value).over(w) == before + after + 1, mean) if full else mean


def marginal_efficiency(df: DataFrame, on: str, loss: str, tokens: str, by: list[str]) -> DataFrame:
    """Loss saved per token since the row before; null where no tokens were added."""
    w = Window.partitionBy(*by).orderBy(on)
    d_loss, d_tokens = F.lag(loss).over(w) - F.col(loss), F.col(tokens) - F.lag(tokens).over(w)
    return df.withColumn("d_loss", d_loss).withColumn("d_tokens", d_tokens).withColumn("efficiency", F.when(F.col("d_tokens") > 0, F.col("d_loss") / F.col("d_tokens")))


def stage_deltas(df: DataFrame, on: str, loss: str, tokens: str, by: list[str]) -> DataFrame:
    """First and last loss per stage; tokens used, or the last count where the difference is not positive."""
    ends = df.groupBy(*by).agg(
        F.min_by(loss, on).alias("first_loss"), F.max_by(loss, on).alias("last_loss"), F.min_by(tokens, on).alias("_a"), F.max_by(tokens, on).alias("_b")
    )
    used = F.col("_b") - F.col("_a")
    return ends.withColumn("d_loss", F.col("first_loss") - F.col("last_loss")).withColumn("tokens", F.when(used > 0, used).otherwise(F.col("_b"))).drop("_a", "_b")


def epoch_markers(df: DataFrame, step: str, epoch: str, by: list[str]) -> DataFrame:
    """Interpolated step of every whole epoch that is crossed."""
    w = Window.partitionBy(*by).orderBy(step)
    own = df.withColumn("_s", F.lag(step).over(w)).withColumn("_e", F.lag(epoch).over(w)).filter(F.floor("_e") < F.floor(epoch))
    crossed = own.withColumn("marker", F.explode(F.sequence(F.floor("_e") + 1, F.floor(epoch))))
    share = (F.col("marker") - F.col("_e")) / (F.col(epoch) - F.col("_e"))
    return crossed.select(*by, "marker", (F.col("_s") + share * (F.col(step) - F.col("_s"))).alias("at_step"))


def downsample(df: DataFrame, on: str, points: int, by: list[str]) -> DataFrame:
    """Evenly spaced rows, the last one included."""
    w = Window.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy(on)) - 1, F.count(F.lit(1)).over(w)
    own = df.withColumn("_i", i).withColumn("_n", n)
    k = F.floor(F.col("_i") * (points - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    first = F.col("_i") == F.ceil(k * (F.col("_n") - 1) / (points - 1))
    return own.filter((F.col("_n") <= points) | first).drop("_i", "_n")


def best_point(df: DataFrame, loss: str, on: str, by: list[str]) -> DataFrame:
    """The first row of the smallest loss."""
    return df.filter(F.col(loss).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(on, loss), F.struct(F.col(loss), F.col(on))).alias("_b")).select(*by, F.col(f"_b.{on}").alias("best_step"), F.col(f"_b.{loss}").alias("best_loss"))


def best_cost_point(df: DataFrame, on: str, loss: str, counters: list[str], by: list[str]) -> DataFrame:
    """The first smallest loss with the counters carried forward to it."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    carried = df.select(*by, on, loss, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in counters)).filter(F.col(loss).isNotNull())
    best = carried.groupBy(*by).agg(F.min(F.struct(loss, on, *counters)).alias("_b"))
    return best.select(*by, F.col(f"_b.{on}").alias("best_step"), F.col(f"_b.{loss}").alias("best_loss"), *(F.col(f"_b.{c}").alias(c) for c in counters))


def early_stop(df: DataFrame, epoch: str, loss: str, least_epoch: float, target: float, by: list[str]) -> DataFrame:
    """The first epoch, from ``least_epoch`` on, whose last known loss is under the target."""
    w = Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    known = df.withColumn("_loss", F.last(loss, ignorenulls=True).over(w))
    return known.filter((F.col(epoch) >= least_epoch) & (F.col("_loss") < target)).groupBy(*by).agg(F.min(epoch).alias("stop_epoch"))


def stream_spans(spans: DataFrame, batch: int) -> DataFrame:
    """spans (ord, alias, n, pace) repeated ``pace`` times, with offsets in instances and the first step of each."""
    rep = spans.select("ord", "alias", "n", F.explode(F.sequence(F.lit(1), F.col("pace"))).alias("rep"))
    w = Window.orderBy("ord", "rep").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(w), F.lit(0))
    return rep.select("ord", "alias", "rep", "n", start.cast("bigint").alias("start"), (start + F.col("n")).cast("bigint").alias("end"), F.floor(start / batch).cast("bigint").alias("first_step"))


def consolidated(train: DataFrame, by: list[str], on: str, loss: str, tokens: str, seconds: str) -> DataFrame:
    """First and last loss, reduction in percent, throughput, and loss saved per million tokens."""
    own = train.groupBy(*by).agg(F.min_by(loss, on).alias("first_loss"), F.max_by(loss, on).alias("last_loss"), F.max(tokens).alias("tokens"), F.max(seconds).alias("seconds"))
    saved = F.col("first_loss") - F.col("last_loss")
    return own.select(
        *by, "first_loss", "last_loss", F.round(F.try_divide(100 * saved, F.col("first_loss")), 3).alias("reduction_pct"),
        F.round(F.try_divide("tokens", "seconds"), 3).alias("tokens_per_second"), F.round(F.try_divide(saved, F.col("tokens") / 1e6), 6).alias("saved_per_mtoken"),
    )


def hardware_summary(df: DataFrame, prefix: str = "gpu", suffix: str = "_reservada_gb") -> DataFrame:
    """Smallest, largest and mean of the row sums of the device columns."""
    columns = [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.select(total.alias("_t")).agg(F.min("_t").alias("min_gb"), F.max("_t").alias("max_gb"), F.avg("_t").alias("mean_gb"))
