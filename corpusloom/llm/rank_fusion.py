"""One ranking from several scores of different scales: empirical percentiles, inverse normal, weighted mean."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import salted_join, split_cumulate

# The coefficients of Acklam's rational approximation of the inverse normal distribution (relative error 1.2e-9).
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
_LOW = 0.02425


def inverse_normal_sql(p: str) -> str:
    """The inverse normal distribution of the SQL expression p, 0 < p < 1, for Spark and any ANSI engine."""
    def horner(c: list[float], x: str, last: str = "") -> str:
        return reduce(lambda acc, v: f"({acc} * {x} + CAST({v!r} AS DOUBLE))", c[1:], f"CAST({c[0]!r} AS DOUBLE)") + last
    def tail(q: str) -> str:
        return f"({horner(_C, q)} / {horner([*_D, 1.0], q)})"
    mid, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    return (f"CASE WHEN {p} < {_LOW} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - _LOW} THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} "
            f"ELSE {mid} * {horner(_A, r)} / {horner([*_B, 1.0], r)} END")


def fused_scores(df: DataFrame, group: str, item: str, scores: dict[str, float], version: str | None = None) -> DataFrame:
    """(group, item, fused): the weighted mean of the normal scores of the item's percentiles within its group.

    scores gives the weight of each score column, higher being better. The percentile of a value is (mean rank of its ties -
    0.5) / number of scored items; it depends on no value's size, so no score's range or distribution counts for more. A null or
    NaN score is not scored: it takes no part in the percentiles and counts as the middle, 0, in the mean. An item with
    several rows in a group counts once, by its newest version (at ties the row with the greatest scores). Rows whose group or
    item is null are left out. An empty table gives no rows.
    """
    names = list(scores)
    val = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    # The column names of df may be anything: only internal names are used from here on.
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(
        F.max(F.struct((F.col(version) if version else F.lit(0)).alias("v"), *[val[c].alias(f"s{k}") for k, c in enumerate(names)])).alias("m"))
    long = rows.select("g", "i", F.posexplode(F.array(*[F.col(f"m.s{k}") for k in range(len(names))])).alias("k", "s"))
    scored = long.filter("s is not null")
    ties = scored.groupBy("g", "k", "s").agg(F.count(F.lit(1)).alias("n"))
    before = split_cumulate(ties, ["g", "k"], ["s"], "n", "below")
    sizes = before.groupBy("g", "k").agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("values"))
    total = before.agg(F.sum("n"), F.count(F.lit(1))).first()
    placed = salted_join(before, sizes, ["g", "k"], "values", total[1])
    z = placed.withColumn("p", (F.col("below") + F.col("n") / 2) / F.col("of")).select("g", "k", "s", "n", F.expr(inverse_normal_sql("p")).alias("z"))
    weights = F.array(*[F.lit(float(scores[c])) for c in names])
    parts = salted_join(scored, z, ["g", "k", "s"], "n", total[0] or 0).select("g", "i", (F.col("z") * weights[F.col("k")]).alias("wz"))
    none = long.filter("s is null").select("g", "i", F.lit(0.0).alias("wz"))
    return parts.unionByName(none).groupBy("g", "i").agg((F.sum("wz") / F.lit(float(sum(scores.values())))).alias("fused")).select(
        F.col("g").alias(group), F.col("i").alias(item), "fused")


def ranking(fused: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, fused, rank): rank 1 is the best of its group; scores that agree to 9 decimals go by item."""
    f = fused.withColumn("_f", -F.round("fused", 9)).withColumn("_one", F.lit(1).cast("long"))
    return split_cumulate(f, [group], [F.col("_f"), F.col(item)], "_one", "_r").select(group, item, "fused", (F.col("_r") + 1).alias("rank"))


def first_of_ranking(fused: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item): rank 1 of ranking(), without ranking the rest."""
    return fused.groupBy(group).agg(F.min(F.struct((-F.round("fused", 9)).alias("f"), F.col(item).alias("i"))).alias("m")).select(group, F.col("m.i").alias(item))
