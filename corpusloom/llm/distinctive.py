"""How distinctive a term is for a record: residual inverse document frequency times the term's frequency in the record.

The residual is the observed -log2(df / N) less what a Poisson process with the term's collection frequency would give,
-log2(1 - exp(-cf / N)). Terms spread as chance spreads them score about 0, terms concentrated in few records score high.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import salted_join


def clean_postings(df: DataFrame, record: str, term: str, frequency: str) -> DataFrame:
    """(record, term, tf): terms in lower case, spellings added up.

    Rows repeated exactly count once; rows with a null record, a null or empty term or a null frequency are left out, so is
    anything whose frequency is not positive. Other columns play no part.
    """
    ok = df.filter(F.col(record).isNotNull() & (F.length(F.col(term)) > 0) & (F.col(frequency) > 0))
    once = ok.select(F.col(record).alias("r"), F.col(term).alias("t"), F.col(frequency).cast("long").alias("f")).distinct()
    return once.groupBy("r", F.lower("t").alias("t")).agg(F.sum("f").alias("f"))


def distinctiveness(df: DataFrame, record: str, term: str, frequency: str) -> DataFrame:
    """(record, term, tf, df, cf, score) of each term of each record, over all records.

    Empty tables give no rows. Terms in every record score at most 0.
    """
    post = clean_postings(df, record, term, frequency)
    stats = post.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("cf"))
    n, rows = post.agg(F.count_distinct("r"), F.count(F.lit(1))).first()
    n = float(max(n, 1))
    residual = -F.log2(F.col("df") / n) + F.log2(1 - F.exp(-F.col("cf") / n))
    scored = salted_join(post, stats.withColumn("residual", residual), ["t"], "df", rows)
    return scored.select(F.col("r").alias(record), F.col("t").alias(term), F.col("f").alias("tf"), "df", "cf", (F.col("f") * F.col("residual")).alias("score"))


def most_distinctive(scored: DataFrame, record: str, term: str) -> DataFrame:
    """(record, term): the term with the highest score of each record; scores that agree to 9 decimals go by term."""
    return scored.groupBy(record).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), F.col(term).alias("t"))).alias("m")).select(
        record, F.col("m.t").alias(term))
