"""Joins and ranks in which no key, however hot, is gathered into one task."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: A key is hot if it holds more than this share of the rows; so there are at most 1 / HOT_SHARE of them, whatever the data.
HOT_SHARE = 1 / 512
SALTS = 64


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right; rows is right's column with the number of left's rows of the key (alike in each of its rows), total their sum.

    The hot keys, at most 512 by their definition, are broadcast to salt left's rows; right repeats only those. Rows with a
    null key join nothing. Other column names must not clash.
    """
    hot = F.col(rows) > total * HOT_SHARE
    marks = F.broadcast(right.filter(hot).select(*keys).distinct().withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") if t == "variant" else F.col(f"`{c}`") for c, t in left.dtypes if not t.startswith("map")]), F.lit(SALTS)).cast("int")).otherwise(0)
    a = left.join(marks, keys, "left").withColumn("_salt", spread).drop("_hot")
    b = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def split_cumulate(df: DataFrame, group: list[str], order: list, weight: str, out: str) -> DataFrame:
    """Adds out: the sum of weight over the rows of the group that come before the row in order. order must be unique in a group.

    Rows are cut into ranges of (group, order) of equal size; a window sorts within a range, and the sums of the ranges, one
    row a range and group, are cumulated above.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*group, "_range").agg(F.sum(weight).alias("_sum"))
    upto = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [own[c].eqNullSafe(base[c]) for c in [*group, "_range"]])
    return own.join(base, same).select(*[own[c] for c in df.columns], (own["_before"] + base["_base"]).alias(out))
