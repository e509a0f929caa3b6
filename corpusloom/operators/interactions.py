"""What users did with answers: failures, their windows, knowledge gaps and issues, deltas for the co-occurrence, drift."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name a subject area.
DOMAINS = "medical medicine health legal law court physics quantum science computer programming software finance economics market".split()


def failure_reason(query: Column, clicks: Column) -> Column:
    return F.when(F.size(F.split(F.trim(query), r"\s+")) == 1, "ambiguous_query").when(clicks == 0, "out_of_domain").otherwise("low_confidence")


def domain(query: Column) -> Column:
    out = F.lit("unknown")
    for d in reversed(DOMAINS):
        out = F.when(F.contains(F.lower(query), F.lit(d)), d).otherwise(out)
    return out


def failures(trajectories: DataFrame) -> DataFrame:
    """The abandoned of (query_id, query_text, n_clicks, avg_dwell, status, created_at), with reason and domain."""
    return trajectories.filter("status = 'abandoned'").withColumn("reason", failure_reason(F.col("query_text"), F.col("n_clicks"))).withColumn("domain", domain(F.col("query_text")))


def window_stats(failed: DataFrame, hours: dict[str, int]) -> DataFrame:
    """(window, total, rate, reason, trend): failures in the hours before the newest, rate an hour, the commonest reason (ties: first by name).

    trend is increasing for odd totals of two or more, stable for even ones: half the count, rounded down, is compared with the rest.
    """
    last = failed.agg(F.max("created_at")).first()[0]
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("window"), F.lit(h).alias("h")) for k, h in hours.items()])).alias("s")
    inside = failed.select("*", spans).filter(F.col("created_at") >= F.lit(last) - F.make_dt_interval(hours=F.col("s.h")))
    per = inside.groupBy(F.col("s.window").alias("window"), F.col("s.h").alias("h"), "reason").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("window", "h").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "reason")).alias("m")).select(
        "window", "total", (F.col("total") / F.col("h")).alias("rate"), F.col("m.reason").alias("reason"), F.when(F.col("total") < 2, None).when(F.col("total") % 2 == 1, "increasing").otherwise("stable").alias("trend"))


def knowledge_gaps(failed: DataFrame) -> DataFrame:
    """(domain, failures, examples, severity) of domains with five or more out-of-domain failures; the three earliest are examples."""
    f = failed.filter("reason = 'out_of_domain'").withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("created_at", "query_id")))
    g = f.groupBy("domain").agg(F.count(F.lit(1)).alias("failures"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "query_text")))).alias("e"))
    return g.filter("failures >= 5").select("domain", "failures", F.array_join(F.transform("e", lambda x: x["query_text"]), "; ").alias("examples"),
                                            F.when(F.col("failures") >= 15, "high").when(F.col("failures") >= 10, "medium").otherwise("low").alias("severity"))


def systemic_issues(failed: DataFrame) -> DataFrame:
    """(issue, affected, severity): many clicks left soon, many ambiguous queries."""
    n = failed.agg(F.count(F.when((F.col("n_clicks") > 0) & (F.col("avg_dwell") < 10), 1)).alias("ranking_quality"), F.count(F.when(F.col("reason") == "ambiguous_query", 1)).alias("query_ambiguity"))
    rows = n.unpivot([], ["ranking_quality", "query_ambiguity"], "issue", "affected").filter("affected >= 10")
    return rows.withColumn("severity", F.when((F.col("issue") == "ranking_quality") & (F.col("affected") >= 20), "high").otherwise("medium"))


def diagnostics(failed: DataFrame) -> DataFrame:
    """(kind, title, severity, place): gaps and issues, the most severe first."""
    g = knowledge_gaps(failed).select(F.lit("knowledge_gap").alias("kind"), F.concat(F.lit("Knowledge gap in '"), "domain", F.lit("' domain")).alias("title"), "severity")
    i = systemic_issues(failed).select(F.lit("systemic_issue").alias("kind"), F.col("issue").alias("title"), "severity")
    level = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return g.unionByName(i).withColumn("place", F.row_number().over(Window.orderBy(level, "kind", "title")))  # a few rows: domains and issues


def learning_phase(coherence: Column) -> Column:
    return F.when(coherence < 0.3, "exploration").when(coherence < 0.7, "consolidation").otherwise("exploitation")


def health(coherence: Column) -> Column:
    return F.when(coherence > 0.5, "healthy").when(coherence > 0.3, "degraded").otherwise("quarantined")


def series_statistics(df: DataFrame, at: str, value: str) -> DataFrame:
    """One row: mean, population deviation, slope against the index, least, most and last less first of a series."""
    s = df.withColumn("i", F.row_number().over(Window.orderBy(at)) - 1)
    return s.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.regr_slope(F.col(value), F.col("i")).alias("slope"), F.min(value).alias("least"), F.max(value).alias("most"),
                 (F.max_by(value, "i") - F.min_by(value, "i")).alias("delta"))


def distribution_shift(df: DataFrame, at: str, vector: str, last: int, threshold: float = 0.3) -> DataFrame:
    """One row (distance, spread, score, shifted): the mean of the last vectors against the mean of the earlier ones."""
    edge = df.select(at).orderBy(F.desc(at)).limit(last).agg(F.min(at)).first()[0]
    ranked = df.withColumn("_late", F.col(at) >= F.lit(edge)).select("_late", F.posexplode(vector).alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    per = ranked.groupBy("k").agg(F.avg(F.when(F.col("_late"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("_late"), F.col("x"))).alias("b"), F.var_pop(F.when(~F.col("_late"), F.col("x"))).alias("v"))
    one = per.agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("distance"), F.sqrt(F.avg("v")).alias("spread"))
    return one.withColumn("score", F.col("distance") / (F.col("spread") + 1e-6)).withColumn("shifted", F.col("score") > threshold)


def curated(cooc: DataFrame, deltas: DataFrame, phase_rate: float) -> DataFrame:
    """(a, b, w): the co-occurrence with deltas (a, b, delta, confidence) added at the phase's rate, higher with confidence."""
    beta = phase_rate * (1 + (F.col("confidence") - 0.5) * 0.5)
    d = deltas.select("a", "b", (F.col("delta") * F.least(F.greatest(beta, F.lit(0.0)), F.lit(1.0))).alias("w"))
    return cooc.unionByName(d).groupBy("a", "b").agg(F.sum("w").alias("w"))


def merged(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """(a, b, w): the weighted sum of co-occurrences; cells off the diagonal count twice, as both of their mirrored triplets are added."""
    out = None
    for df, share in parts:
        x = df.select("a", "b", (F.col("w") * share * F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)).alias("w"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("a", "b").agg(F.sum("w").alias("w"))


def success_deltas(clicks: DataFrame, least: float = 30.0) -> DataFrame:
    """(a, b, weight): pairs of a query's terms with those of results (query_terms, result_terms, dwell) looked at long enough, summed by confidence."""
    n = (F.col("dwell") - least) / 30
    c = clicks.filter(F.col("dwell") >= least).withColumn("c", F.least(F.greatest(n / (1 + n), F.lit(0.5)), F.lit(1.0)))
    return c.select(F.explode("query_terms").alias("a"), "result_terms", "c").select("a", F.explode("result_terms").alias("b"), "c").groupBy("a", "b").agg(F.sum("c").alias("weight"))


def failure_deltas(failed: DataFrame, terms) -> DataFrame:
    """(a, b, weight): .5 for each two terms of low-confidence queries that were given up; terms makes an array of the query text."""
    t = failed.filter("reason = 'low_confidence'").select("query_id", F.posexplode(terms(F.col("query_text"))).alias("i", "a"))
    return t.join(t.select("query_id", F.col("i").alias("j"), F.col("a").alias("b")), "query_id").filter("i < j").groupBy("a", "b").agg(F.sum(F.lit(0.5)).alias("weight"))


def merge_decision(alignment: Column) -> Column:
    return F.when(alignment >= 0.9, "merge").when(alignment >= 0.7, "review").otherwise("separate")
