"""Token co-occurrence and vector arithmetic: sparse sums as aggregates, dense work in the JVM's array functions."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.skew import split_cumulate
from corpusloom.session import cut

WINDOW = 5
#: Tokens whose pairs are counted at once.
AT_ONCE = 1 << 20
#: More than rounding to nine digits can move a relevance.
MARGIN = 2e-9
#: Queries that meet a block of cells at once, and cells of a block, about.
QUERIES, CELLS = 512, 1_000_000


def pairs(tokens: Column) -> Column:
    """ARRAY<STRUCT<a, b, w>> of the co-occurrences in a list of tokens, each once.

    Of five tokens or more, the middle one of each window of five with each of the others that differs, at .2. Of fewer, all
    positions with each other, equal tokens too, at 1 / number.
    """
    def near(ts: Column) -> Column:
        n = F.size(ts)
        mid = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(n - 3, F.lit(2))), lambda i: F.transform(F.array(*[F.lit(x) for x in (-2, -1, 1, 2)]), lambda o: F.struct(
            F.get(ts, i).alias("a"), F.get(ts, i + o).alias("b"), F.lit(1 / WINDOW).alias("w")))))
        few = F.flatten(F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.lit(WINDOW)), lambda b: F.struct(a.alias("a"), b.alias("b"), (1.0 / n).alias("w")))))
        return F.when(n >= WINDOW, F.filter(mid, lambda p: p["a"] != p["b"])).otherwise(few)

    return F.get(F.transform(F.array(tokens), near), F.lit(0))


def words(chunks: DataFrame) -> Column:
    """The tokens of each chunk: ts where they have been taken apart, else of content."""
    return F.col("ts") if "ts" in chunks.columns else T.tokens(F.col("content"))


def cooccurrence(chunks: DataFrame) -> DataFrame:
    """(a, b, w) with a and b in both orders, the weights of pairs() summed over all chunks; pairs of a token with itself once."""
    p = chunks.select(words(chunks).alias("ts")).filter("size(ts) > 1").mapInArrow(_counted, "a string, b string, w double")
    # Summed one way round before the mirror is made, and once for both: half the shuffle.
    once = p.groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return once.select("w", F.explode(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)).alias("p")).select("p.a", "p.b", "w")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of pairs() of lists of tokens, the lesser token first; of about AT_ONCE tokens at once."""
    for batch in batches:
        lists, ends = batch.column(0), np.cumsum(pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            own = lists.slice(lo, hi - lo)
            lo = hi
            flat, size = own.flatten().dictionary_encode(), pc.list_value_length(own).to_numpy(zero_copy_only=False)
            names = flat.dictionary.take(order := pc.sort_indices(flat.dictionary))
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            code = rank[flat.indices.to_numpy(zero_copy_only=False)]
            n = np.repeat(size, size)
            at = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            mid, keys, weights = (at >= WINDOW // 2) & (at + WINDOW // 2 < n), [], []

            def add(first: np.ndarray, d: int, weight: float) -> None:
                a, b = code[first], code[first + d]
                k, c = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_counts=True)
                keys.append(k)
                weights.append(c * weight)

            for d in range(1, WINDOW // 2 + 1):  # either of two may be the middle of a window
                times = mid[:-d].astype(np.int8) + mid[d:]
                times[(at[d:] < d) | (code[:-d] == code[d:])] = 0
                for t in (1, 2):
                    add(np.flatnonzero(times == t), d, t / WINDOW)
            for d in range(1, WINDOW - 1):
                first = np.flatnonzero((n < WINDOW) & (at + d < n))
                for k in range(d + 1, WINDOW):
                    add(first[n[first] == k], d, 1.0 / k)
            keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            w = np.bincount(at, np.concatenate(weights), len(keys))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // len(names))), names.take(pa.array(keys % len(names))), pa.array(w, pa.float64())], names=["a", "b", "w"])


def quantised(v: Column) -> Column:
    """Values of -1 to 1 as 16-bit numbers, halves away from zero."""
    return F.transform(v, lambda x: F.round(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = dot(a, a) * dot(b, b)
    c = dot(a, b) / F.sqrt(norm)
    return F.when((F.size(a) == F.size(b)) & (norm > 1e-14), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, at, value): the mean of the vectors of each key, a row for each place, so that partial sums form before the shuffle."""
    return df.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("value"))


def compressed(df: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """(key, at, q, scale): the top values of each vector by size, as 8-bit shares of the largest."""
    long = df.select(key, F.posexplode(vector).alias("at", "x"))
    w = Window.partitionBy(key).orderBy(F.abs("x").desc(), "at")
    kept = long.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
    scale = F.max(F.abs(F.col("x").cast("double"))).over(Window.partitionBy(key))
    return kept.withColumn("scale", scale).select(key, "at", F.round(F.col("x").cast("double") / F.col("scale") * 127).cast("int").alias("q"), "scale")


def lanczos(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int, k: int, steps: int = 120, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a symmetric sparse matrix of n (at most 10,000) rows, by Lanczos with full reorthogonalisation."""
    order = np.argsort(rows, kind="stable")
    rows, cols, w = rows[order], cols[order], w[order]
    return lanczos_by(lambda v: np.bincount(rows, weights=w * v[cols], minlength=n), n, k, steps, seed)


def lanczos_by(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, steps: int = 120, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """lanczos() of a matrix that is known by its product with a vector."""
    steps = min(steps, n)
    v = np.random.default_rng(seed).standard_normal(n)
    basis, alpha, beta = np.zeros((steps, n)), [], []
    v /= np.linalg.norm(v)
    for j in range(steps):
        basis[j] = v
        u = times(v)
        alpha.append(float(u @ v))
        u -= basis[: j + 1].T @ (basis[: j + 1] @ u)
        u -= basis[: j + 1].T @ (basis[: j + 1] @ u)
        b = float(np.linalg.norm(u))
        if b < 1e-10 or j == steps - 1:
            basis = basis[: j + 1]
            break
        beta.append(b)
        v = u / b
    m = len(alpha)
    t = np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1)
    values, vectors = np.linalg.eigh(t)
    top = np.argsort(values)[::-1][:k]
    return values[top], basis.T @ vectors[:, top]


def components(cells: int) -> int:
    """How many components a matrix of so many cells gets."""
    return 12 if cells > 1_000_000 else 16 if cells > 250_000 else 24 if cells > 50_000 else 32


def eigenpairs(cooc: DataFrame, k: int | None = None, cap: int = 10_000, most: int = 2_000_000, written: bool = False) -> DataFrame:
    """(component, eigenvalue, token, value) of the co-occurrence among the cap most frequent tokens; ties by token. k by components() if not given.

    written: cooc is a written table. A matrix of at most most cells (32 MB) comes to the driver; of a larger one only its products with a vector do, cap numbers each.
    """
    spark = cooc.sparkSession
    cooc = cooc if written else cut(cooc, "cooccurrence")
    k = components(cooc.count()) if k is None else k
    top = cooc.groupBy("a").agg(F.sum("w").alias("s")).orderBy(F.desc(F.round("s", 6)), "a").limit(cap)
    names = [r[0] for r in top.select("a").collect()]
    n, k = len(names), min(k, max(len(names) - 1, 1))
    ids = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "t string, i int")
    m = cut(cooc.join(ids.withColumnRenamed("t", "a").withColumnRenamed("i", "ia"), "a").join(ids.withColumnRenamed("t", "b").withColumnRenamed("i", "ib"), "b").select("ia", "ib", "w"), "matrix")
    if m.count() <= most:
        kept = m.toArrow()  # not as rows, which take ten times the memory
        values, vectors = lanczos(*(kept[c].to_numpy() for c in ("ia", "ib", "w")), n, k)
    else:
        values, vectors = lanczos_by(lambda v: _product(m, v), n, k)
    found = len(values)
    columns = (np.repeat(np.arange(found, dtype=np.int32), n), np.repeat(values, n), pa.array(names * found, pa.string()), vectors[:, :found].T.ravel())
    return spark.createDataFrame(pa.table(dict(zip(("component", "eigenvalue", "token", "value"), columns))), "component int, eigenvalue double, token string, value double")


def _product(m: DataFrame, v: np.ndarray) -> np.ndarray:
    x = m.sparkSession.createDataFrame(list(enumerate(v.tolist())), "ib int, x double")
    out = np.zeros(len(v))
    for r in m.join(x, "ib").groupBy("ia").agg(F.sum(F.col("w") * F.col("x")).alias("y")).collect():
        out[r.ia] = r.y
    return out


def related_pairs(cooc: DataFrame, scores: DataFrame, top: int, least: float = 0.05) -> DataFrame:
    """(query_id, a, b, relevance, rank): neighbours of a query's scored tokens (query_id, token, score), the best top of each query.

    Half the mean of both tokens' scores and .3 of the weight w as w / (1 + w); cells and relevances under least are left out.
    """
    a = scores.select("query_id", F.col("token").alias("a"), F.col("score").alias("sa"))
    b = scores.select("query_id", F.col("token").alias("b"), F.col("score").alias("sb"))
    p = cooc.filter(F.col("w") >= least).join(a, "a").join(b, ["query_id", "b"], "left")
    rel = 0.25 * (F.col("sa") + F.coalesce("sb", F.lit(0.0))) + 0.3 * F.col("w") / (1 + F.col("w"))
    w = Window.partitionBy("query_id").orderBy(-F.round("relevance", 9), "a", "b")
    return p.select("query_id", "a", "b", rel.alias("relevance")).filter(F.col("relevance") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def neighbours(cooc: DataFrame, wanted: DataFrame, members: list[str], keep: int, least: float = 0.05) -> DataFrame:
    """(a, bs, ws): of the cells of the tokens of wanted (a) those that can be among a query's best: b is one of members, or of the other
    tokens fewer than keep go before it, whatever the query, as their weight is greater, or the same and their name less."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, name = pa.array(members, pa.string()), [], None

        def kept() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            b, w = t["b"].combine_chunks(), t["w"].to_numpy()
            x = 0.3 * w / (1 + w)
            good = np.ones(len(x), bool)
            if len(x) > keep:
                good = x >= np.partition(x, len(x) - keep)[len(x) - keep] - MARGIN
                at = np.flatnonzero(good)
                order = at[np.lexsort((pc.rank(b.take(pa.array(at)), "ascending").to_numpy(), -w[at]))]
                new = np.append(True, w[order][1:] != w[order][:-1])
                good[order[np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) >= keep]] = False
                good |= pc.is_in(b, value_set=known).to_numpy(zero_copy_only=False)
            b, w = b.filter(pa.array(good)), w[good]
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), one(b), one(pa.array(w))], names=["a", "bs", "ws"])

        for batch in batches:
            a = batch.column("a").dictionary_encode()
            code = a.indices.to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)] if len(code) else [0]
            for lo, hi in zip(at, at[1:]):
                own = a.dictionary[int(code[lo])].as_py()
                if held and own != name:
                    yield kept()
                name = own
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield kept()

    cells = cooc.filter(F.col("w") >= least).join(wanted, "a", "left_semi").select("a", "b", "w")
    return cells.repartition("a").sortWithinPartitions("a").mapInArrow(run, "a string, bs array<string>, ws array<double>")


def best_pairs(cooc: DataFrame, scores: DataFrame, members: list[str], top: int, each: int, least: float = 0.05) -> DataFrame:
    """related_pairs(), where a query scores at most each tokens, all of them of members: only neighbours() meet the queries, block by block."""
    scores = cut(scores, "token-scores")
    kept = cut(neighbours(cooc, cut(scores.select(F.col("token").alias("a")).distinct(), "scored"), members, top + each, least), "neighbours")
    cells = kept.agg(F.coalesce(F.sum(F.size("bs")), F.lit(0))).first()[0]
    blocks = lambda key, n, size: F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size)))).cast("int").alias("block")
    rows = cut(kept.groupBy(blocks("a", cells, CELLS)).agg(F.collect_list(F.struct("a", "bs", "ws")).alias("rows")).select("rows"), "cells")
    per = cut(scores.groupBy("query_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("score").alias("scores")), "scored-queries")
    queries = cut(per.groupBy(blocks("query_id", per.count(), QUERIES)).agg(F.collect_list(F.struct("query_id", "tokens", "scores")).alias("queries")).select("queries"), "asked")
    id_type = scores.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind, held = to_arrow_type(id_type), None
        for batch in batches:
            for i in range(batch.num_rows):
                if held is None or not held[0].equals(batch.column(0)[i].values):
                    a, bs, ws = batch.column(0)[i].values.flatten()
                    ends, a = np.append(0, np.cumsum(pc.list_value_length(bs).to_numpy(zero_copy_only=False))).astype(int), a.to_pylist()
                    flat = bs.flatten().dictionary_encode()
                    names = sorted({*a, *flat.dictionary.to_pylist()})
                    code = {t: k for k, t in enumerate(names)}
                    b = np.array([code[t] for t in flat.dictionary.to_pylist()], int)[flat.indices.to_numpy(zero_copy_only=False)]
                    w = ws.flatten().to_numpy(zero_copy_only=False)
                    held = batch.column(0)[i].values, {t: (lo, hi) for t, lo, hi in zip(a, ends, ends[1:])}, names, code, b, 0.3 * w / (1 + w)
                _, of, names, code, b, x = held
                ids, ns, out, known = [], [], [], np.zeros(len(names))
                for q in batch.column(1)[i].values.to_pylist():
                    own = [(code[t], s, *of.get(t, (0, 0))) for t, s in zip(q["tokens"], q["scores"]) if t in code]
                    if not own:
                        continue
                    cs, ss = np.array([o[0] for o in own]), np.array([o[1] for o in own])
                    size = np.array([o[3] - o[2] for o in own])
                    known[cs] = ss
                    qb = np.concatenate([b[o[2] : o[3]] for o in own])
                    rel = 0.25 * (np.repeat(ss, size) + known[qb]) + np.concatenate([x[o[2] : o[3]] for o in own])
                    known[cs] = 0.0
                    at = np.flatnonzero(rel >= (max(least, np.partition(rel, len(rel) - top)[len(rel) - top] - MARGIN) if len(rel) > top else least))
                    qa, qb, rel = np.repeat(cs, size)[at], qb[at], rel[at]
                    if len(at) > 2 * top:  # of those exactly alike the first by name
                        order = np.lexsort((qb, qa, -rel))
                        new = np.append(True, rel[order][1:] != rel[order][:-1])
                        order = order[np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) < top]
                        qa, qb, rel = qa[order], qb[order], rel[order]
                    ids.append(q["query_id"])
                    ns.append(len(rel))
                    out.append((qa, qb, rel))
                if ids:
                    text = pa.array(names, pa.string())
                    qa, qb, rel = (np.concatenate([o[k] for o in out]) for k in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), ns))), text.take(pa.array(qa)), text.take(pa.array(qb)), pa.array(rel, pa.float64())], names=["query_id", "a", "b", "relevance"])

    p = rows.crossJoin(queries).mapInArrow(run, f"query_id {id_type.simpleString()}, a string, b string, relevance double")
    w = Window.partitionBy("query_id").orderBy(-F.round("relevance", 9), "a", "b")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def token_boosts(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, token, boost): the highest relevance of each token of the pairs that the query (query_id, token) does not have."""
    each = pairs.select("query_id", F.explode(F.array("a", "b")).alias("token"), "relevance").groupBy("query_id", "token").agg(F.max("relevance").alias("boost"))
    return each.join(asked.select("query_id", "token"), ["query_id", "token"], "left_anti")


def projections(chunks: DataFrame, eigen: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, component, value): each chunk as the sum of its tokens' rows of the eigenvectors, brought to length 1."""
    t = chunks.select("doc_id", "chunk_index", F.explode(T.tokens(F.col("content"))).alias("token")).groupBy("doc_id", "chunk_index", "token").agg(F.count(F.lit(1)).alias("n"))
    s = t.join(eigen, "token").groupBy("doc_id", "chunk_index", "component").agg(F.sum(F.col("n") * F.col("value")).alias("x"))
    norm = F.sqrt(F.sum(F.pow("x", 2)).over(Window.partitionBy("doc_id", "chunk_index")))
    return s.select("doc_id", "chunk_index", "component", F.when(norm > 1e-10, F.col("x") / norm).otherwise(0.0).alias("value"))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(token, token_id): tokens numbered from 0 in the order in which they are first seen, by document, chunk and place."""
    seen = chunks.select("doc_id", "chunk_index", F.posexplode(T.tokens(F.col("content"))).alias("pos", "token")).groupBy("token").agg(F.min(F.struct("doc_id", "chunk_index", "pos")).alias("at"))
    flat = seen.select("token", "at.doc_id", "at.chunk_index", "at.pos").withColumn("one", F.lit(1).cast("long"))
    return split_cumulate(flat, [], [F.col("doc_id"), F.col("chunk_index"), F.col("pos")], "one", "token_id").select("token", "token_id")


def capped_cooccurrence(chunks: DataFrame, cap: int = 10_000) -> DataFrame:
    """(a, b, w) as cooccurrence(), but of each chunk only the pairs before the first that has a token numbered cap or more."""
    ids = vocabulary(chunks)
    p = chunks.select("doc_id", "chunk_index", F.posexplode(pairs(T.tokens(F.col("content")))).alias("ord", "p")).select("doc_id", "chunk_index", "ord", "p.*")
    beyond = ids.filter(F.col("token_id") >= cap).select("token")
    bad = p.select("doc_id", "chunk_index", "ord", F.explode(F.array("a", "b")).alias("token")).join(beyond, "token", "left_semi").groupBy("doc_id", "chunk_index").agg(F.min("ord").alias("first"))
    kept = p.join(bad, ["doc_id", "chunk_index"], "left").filter(F.col("first").isNull() | (F.col("ord") < F.col("first")))
    once = kept.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    return once.unionByName(once.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
