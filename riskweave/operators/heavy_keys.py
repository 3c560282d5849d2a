"""Per-key results when a few keys hold most rows, by value-frequency compression.

Rows are first grouped by (key, value), which spreads a heavy key over all tasks and pre-aggregates on the map side; what
remains per key is one weighted row for each distinct value. Counts, distinct counts, means, modes and percentiles are
then exact functions of the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.runtime import broadcast_if_small


def compress(df: DataFrame, key: str, value: str | Column, weight: str = "_w") -> DataFrame:
    """(key, value, weight): one row for each distinct pair; null keys and null values are kept as groups of their own."""
    v = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).alias("_key"), v.alias("_val")).groupBy("_key", "_val").agg(F.count(F.lit(1)).alias(weight))


def key_summary(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """(key, n, n_values, mean, mode): exact, nulls and NaN left out of n_values, mean and mode.

    Ties of the mode go to the smallest value. A key whose values are all null has n_values 0, null mean and mode. An
    empty table gives no rows. Any further columns of ``df`` are ignored.
    """
    w = compress(df, key, value)
    ok = F.col("_val").isNotNull()
    if dict(w.dtypes)["_val"] in ("double", "float"):
        ok = ok & ~F.isnan("_val")
    numeric = dict(w.dtypes)["_val"] in ("double", "float", "int", "bigint", "smallint", "tinyint")
    mean = (
        F.sum(F.when(ok, F.col("_val") * F.col("_w"))) / F.sum(F.when(ok, F.col("_w")))
        if numeric
        else F.lit(None).cast("double")
    )
    best = F.min_by("_val", F.struct((-F.col("_w")).alias("w"), F.col("_val").alias("v"))).alias("mode")
    a = w.groupBy("_key").agg(F.sum("_w").alias("n"), F.count(F.when(ok, 1)).alias("n_values"), mean.alias("mean"))
    m = w.where(ok).groupBy(F.col("_key").alias("_k")).agg(best)
    return a.join(m, F.col("_key").eqNullSafe(F.col("_k")), "left").select(F.col("_key").alias(key), "n", "n_values", "mean", "mode")


def key_percentiles(df: DataFrame, key: str, value: str | Column, at: list[float], bins: int = 64) -> DataFrame:
    """(key, p, value): the smallest value whose cumulative weight reaches p of the key's non-null weight; exact.

    The weighted values of one key may still be many (a continuous value), so the prefix sum runs in two levels: weights
    summed in ``bins`` value ranges a key, then only inside the range that holds the wanted position. The ranges end at
    approximate quantiles of the key's distinct values, so that outliers don't crowd the rest into one of them; the result
    doesn't depend on where they end.
    """
    w = compress(df, key, value).where(F.col("_val").isNotNull() & ~F.isnan(F.col("_val").cast("double")))
    lim = w.groupBy(F.col("_key").alias("_k")).agg(F.percentile_approx("_val", [i / bins for i in range(1, bins)], F.lit(20 * bins)).alias("_ends"), F.sum("_w").alias("_tot"))
    lim = broadcast_if_small(lim)  # else a shuffle join, in which AQE splits the heavy keys
    b = F.aggregate("_ends", F.lit(0), lambda n, end: n + (end < F.col("_val")).cast("int"))
    x = w.join(lim, F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "_val", "_w", "_tot", b.alias("_bin"))
    per = x.groupBy("_key", "_bin").agg(F.sum("_w").alias("_bw"), F.max("_tot").alias("_tot"))
    upto = Window.partitionBy("_key").orderBy("_bin")
    edge = per.withColumn("_cum", F.sum("_bw").over(upto)).withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in at])))
    edge = edge.withColumn("_need", F.greatest(F.lit(1), F.ceil(F.col("_p") * F.col("_tot"))))
    edge = edge.where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_bw") < F.col("_need")))
    e = edge.select(F.col("_key").alias("_k2"), F.col("_bin").alias("_b2"), "_p", (F.col("_need") - (F.col("_cum") - F.col("_bw"))).alias("_left"))
    y = x.join(e, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_bin") == F.col("_b2"))).select("_key", "_val", "_w", "_p", "_left")
    inner = Window.partitionBy("_key", "_p").orderBy("_val")
    y = y.withColumn("_c", F.sum("_w").over(inner)).where((F.col("_c") >= F.col("_left")) & (F.col("_c") - F.col("_w") < F.col("_left")))
    return y.select(F.col("_key").alias(key), F.col("_p").alias("p"), F.col("_val").alias("value"))


def heavy_keys(df: DataFrame, key: str, unit: str, share: float) -> DataFrame:
    """(key, n): keys holding more than ``share`` of the distinct ``unit`` values.

    Grouping by (key, unit) first removes repeats and spreads the heavy keys; the second grouping then adds at most one
    partial row a key and task. A null key or null unit never counts.
    """
    pairs = df.select(F.col(key).alias("_k"), F.col(unit).alias("_u")).where("_k is not null and _u is not null").groupBy("_k", "_u").agg(F.lit(1).alias("one"))
    per = pairs.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.select("_u").distinct().count()
    return per.where(F.col("n") > F.lit(share) * F.lit(total)).select(F.col("_k").alias(key), "n")
