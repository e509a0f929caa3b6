"""What is learned from how queries went: patterns, pairs, edits, mappings, rates, and checks before a matrix is changed."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the three features of an edit.
EDIT_WEIGHTS = (0.4, 0.3, 0.3)


def words(query: Column) -> Column:
    """A query's words in lower case, cut at white space."""
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")


def patterns(trajectories: DataFrame) -> DataFrame:
    """(query_id, succeeded, failed) of (query_id, n_clicks, longest_dwell, praised, status): it went well with a look of 30 seconds or praise,
    and badly if it was given up without a click. Nulls count as none."""
    abandoned = F.coalesce(F.col("status") == "abandoned", F.lit(False))
    return trajectories.select("query_id", (F.coalesce(F.col("longest_dwell") >= 30, F.lit(False)) | F.coalesce("praised", F.lit(False))).alias("succeeded"),
                               (abandoned & (F.coalesce("n_clicks", F.lit(0)) == 0)).alias("failed"))


def term_pairs(trajectories: DataFrame) -> DataFrame:
    """(query_id, term1, term2, confidence): each two words of a query, in order: .9 if it was praised, .7 after a look of over 30 seconds, else .5.
    A query's words are few; no pair crosses queries."""
    sure = F.when(F.coalesce("praised", F.lit(False)), 0.9).when(F.coalesce(F.col("longest_dwell") > 30, F.lit(False)), 0.7).otherwise(0.5)
    ws = words(F.col("query_text"))
    each = F.flatten(F.transform(ws, lambda w, i: F.transform(F.slice(ws, i + 2, F.greatest(F.size(ws) - i - 1, F.lit(0))), lambda v: F.struct(w.alias("term1"), v.alias("term2")))))
    return trajectories.filter("query_text is not null").select("query_id", F.explode(each).alias("p"), sure.alias("confidence")).select("query_id", "p.*", "confidence")


def disambiguation(reformulations: DataFrame) -> DataFrame:
    """(query_id, original, added): the words that the last reformulation (query_id, at, original, reformulated) of each query added, if it
    added any and is at most 100 edits away."""
    last = reformulations.groupBy("query_id").agg(F.max_by(F.struct("original", "reformulated"), "at").alias("r")).select("query_id", "r.*")
    split = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    new = F.filter(split(F.col("reformulated")), lambda w: ~F.array_contains(split(F.col("original")), w))
    return last.filter(F.levenshtein("original", "reformulated") <= 100).select("query_id", "original", new.alias("added")).filter(F.size("added") >= 1)


def edit_quality(original: Column, added: Column) -> Column:
    """How good an edit promises to be: number and mean length of the added words and length of the query (bytes), each against a cap."""
    n = F.size(added)
    mean = F.when(n > 0, F.aggregate(added, F.lit(0.0), lambda s, w: s + F.octet_length(w)) / n).otherwise(0.0)
    a, b, c = EDIT_WEIGHTS
    s = a * F.least(n / 5, F.lit(1.0)) + b * F.least(F.octet_length(original) / 20, F.lit(1.0)) + c * F.least(mean / 15, F.lit(1.0))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def use_adaptive(confidence: Column, gap: Column, least: float = 0.7, most: float = 0.2) -> Column:
    return (confidence >= least) & (gap <= most)


def adapted(embeddings: DataFrame, vector: str, rate: float) -> DataFrame:
    """(i, j, w): the sum of rate times the outer product of each vector with itself, summed before the shuffle."""
    v = F.col(vector)
    cells = F.flatten(F.transform(v, lambda x, i: F.transform(v, lambda y, j: F.struct(i.alias("i"), j.alias("j"), (rate * x.cast("double") * y.cast("double")).alias("w")))))
    return embeddings.select(F.explode(cells).alias("c")).select("c.*").groupBy("i", "j").agg(F.sum("w").alias("w"))


def world_model(observed: DataFrame) -> DataFrame:
    """(signature, result, confidence, observations) of observations (query_text, result, dwell, at): for each kind of query, how sure each result is.

    A kind is its words in order. A look of s seconds counts (s / 30) / (1 + s / 30); each new one is averaged with what was there, in order
    of at: so the k-th from the end weighs 2^-k, the first as the second. Ties in at go by dwell.
    """
    d = F.col("dwell") / 30
    key = ["signature", "result"]
    c = observed.filter("query_text is not null and result is not null and dwell is not null").select(F.array_join(words(F.col("query_text")), " ").alias("signature"), "result", "at", "dwell", F.least(F.greatest(d / (1 + d), F.lit(0.0)), F.lit(1.0)).alias("c"))
    # Only the last sixty of a result can show in a double; the others are counted.
    back = c.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("dwell"))))
    n = c.groupBy(*key).agg(F.count(F.lit(1)).alias("observations"))
    weight = F.when(F.col("k") == F.col("observations"), F.pow(F.lit(0.5), F.col("k") - 1)).otherwise(F.pow(F.lit(0.5), F.col("k")))
    return back.filter("k <= 60").join(n, key).groupBy(*key, "observations").agg(F.sum(F.col("c") * weight).alias("confidence")).select(*key, "confidence", "observations")


def prediction_accuracy(model: DataFrame, least: float = 0.7) -> DataFrame:
    """(signature, accuracy): the share of a kind's results that are sure."""
    return model.groupBy("signature").agg(F.avg((F.col("confidence") >= least).cast("double")).alias("accuracy"))


def learning_rate(confidence: Column, shifted: Column, base: float = 0.1, multiplier: float = 0.5, boost: float = 2.0) -> Column:
    """The rate at which a delta is taken in: more with confidence, more if the distribution has shifted; .001 to 1."""
    return F.least(F.greatest(base * (1 + (confidence - 0.5) * multiplier) * F.when(shifted, boost).otherwise(1.0), F.lit(0.001)), F.lit(1.0))


def collapse_risk(basis: np.ndarray, pairs: int, rate: float, confidence: float, most: float = 0.1, least: float = 0.3) -> str | None:
    """Why a delta of so many pairs must not be taken in: excessive_drift or low_coherence; None if it may."""
    if confidence > 0.95 or rate < 0.001:
        return None
    scale = np.sqrt(pairs) * rate * 0.01
    if np.sqrt(((scale * basis) ** 2).sum()) / basis.size > most:
        return "excessive_drift"
    new = basis * (1 + scale)
    gap = 1 - abs(float(new[:, 0] @ new[:, 1])) if basis.shape[1] > 1 else 0.0
    return "low_coherence" if gap < least else None


def hypotheses(failed: DataFrame, last: int = 10, least: int = 3) -> DataFrame:
    """(reason, failures, edit, confidence): what the last failures (reason, created_at) suggest, for reasons that hold of least of them."""
    recent = failed.orderBy(F.desc("created_at"), "query_id").limit(last)
    edit = F.when(F.col("reason") == "ambiguous_query", "add_context").when(F.col("reason") == "out_of_domain", "change_domain").otherwise("add_concepts")
    sure = F.when(F.col("reason") == "ambiguous_query", 0.6).when(F.col("reason") == "out_of_domain", 0.5).otherwise(0.7)
    return recent.groupBy("reason").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= least).select("reason", "failures", edit.alias("edit"), sure.alias("confidence"))


def subspace_alignment(a: np.ndarray, b: np.ndarray) -> float:
    """The largest singular value of a' b, between 0 and 1; a and b have orthonormal columns and the same shape."""
    if a.shape != b.shape:
        raise ValueError(f"shapes differ: {a.shape}, {b.shape}")
    return float(np.clip(np.linalg.svd(a.T @ b, compute_uv=False).max(initial=0.0), 0.0, 1.0))


def coherent_peers(own: str, bases: dict[str, np.ndarray], least: float = 0.7) -> list[tuple[str, float]]:
    """The other nodes whose space is aligned with one's own, the most aligned first. Nodes are whole stores: a handful."""
    scored = [(n, subspace_alignment(bases[own], b)) for n, b in bases.items() if n != own]
    return sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[1], x[0]))


def merged_or_kept(a: DataFrame, b: DataFrame, alignment: float, drift: float, most: float = 0.1) -> tuple[DataFrame, str]:
    """(matrix (i.e. a, b, w), state): a and b merged half and half, unless they are not aligned (separate) or the merged vectors have drifted too
    far from a's; then a stays as it was (quarantined)."""
    from corpusloom.operators.interactions import merged
    if alignment < 0.7:
        return a, "separate"
    if drift > most:
        return a, "quarantined"
    return merged([(a, 0.5), (b, 0.5)]), "merged" if alignment >= 0.9 else "merged_for_review"
