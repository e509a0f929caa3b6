"""Sums for all pairs of a batch's queries and a corpus's rows (chunks, documents), block by block.

What a term gives a row does not depend on the query, so only that is moved: the rows' lists by term in blocks of about ROWS rows, the
queries in blocks of about QUERIES. Every block of rows meets every block of queries, and the sums of a pair are made there, in numpy; no
row is shuffled for a pair, and of the pairs only those leave that are asked for.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from corpusloom.session import cut

ROWS, QUERIES = 16384, 4096
#: What a list says of a row: the score and inverse frequency of a query's term, that its metadata have the term, that it holds a token, that its metadata have the term as written.
CONTENT, METADATA, TOKEN, WRITTEN = 0, 1, 2, 3
#: More than rounding to nine digits and the order of sums can move a score.
MARGIN = 1e-8
#: Pairs that are handed back at once.
AT_ONCE = 1 << 16

Query = tuple[object, list[str], np.ndarray, np.ndarray, dict]


def packed_rows(rows: DataFrame, n: int) -> DataFrame:
    """Blocks of lists of rows (key, kind, term, score, idf); of those alike in the first three the highest counts. n: how many keys there are, about."""
    block = F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(n / ROWS)))).cast("int")
    own = rows.select(block.alias("block"), F.col("kind").cast("int").alias("kind"), "term", "key", "score", "idf").repartition("block").sortWithinPartitions("block")
    lists = "array<struct<kind: int, term: string, at: array<int>, score: array<double>, idf: array<double>>>"
    return cut(own.mapInArrow(_packed, f"keys array<bigint>, lists {lists}"), "blocks")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block a row of its keys and of lists of places among them; the rows come ordered by block."""
    held: list[pa.RecordBatch] = []

    def lists() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        term = t["term"].combine_chunks().dictionary_encode()
        kind, code = t["kind"].to_numpy(), term.indices.to_numpy(zero_copy_only=False)
        keys, place = np.unique(t["key"].to_numpy(), return_inverse=True)
        changes = lambda c: c[1:] != c[:-1]
        order = np.lexsort((t["idf"].to_numpy(), t["score"].to_numpy(), place, code, kind))
        order = order[np.append(changes(place[order]) | changes(code[order]) | changes(kind[order]), True)]
        kind, code = kind[order], code[order]
        at = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (code[1:] != code[:-1])]))
        ends = pa.array(np.append(at, len(order)), pa.int32())
        of = [pa.ListArray.from_arrays(ends, pa.array(c[order], k)) for c, k in ((place, pa.int32()), (t["score"].to_numpy(), pa.float64()), (t["idf"].to_numpy(), pa.float64()))]
        each = pa.StructArray.from_arrays([pa.array(kind[at], pa.int32()), term.dictionary.take(pa.array(code[at])), *of], names=["kind", "term", "at", "score", "idf"])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(keys, pa.int64()), each)], names=["keys", "lists"])

    for b in batches:
        block = b.column("block").to_numpy()
        at = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for lo, hi in zip(at, at[1:]):
            if held and held[-1].column("block")[0] != b.column("block")[lo]:
                yield lists()
            held.append(b.slice(lo, hi - lo))
    if held:
        yield lists()


def packed_queries(queries: DataFrame, n: int) -> DataFrame:
    """Blocks of queries (query_id, terms: array of (term, weight, numeric), extra: array of (token, boost), and numbers)."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(n / QUERIES)))).cast("int")
    return queries.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(*queries.columns)).alias("queries")).select("queries")


class Block:
    """A block's lists: for each kind and term the places of its rows among keys, with what it gives them."""

    def __init__(self, keys: pa.Array, lists: pa.StructArray):
        kind, term, at, score, idf = lists.flatten()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))]).astype(int).tolist()
        at, score, idf = (a.flatten().to_numpy(zero_copy_only=False) for a in (at, score, idf))
        self.keys, at = keys.to_numpy(zero_copy_only=False), at.astype(np.intp)
        self.of = {(k, t): (at[lo:hi], score[lo:hi], idf[lo:hi]) for k, t, lo, hi in zip(kind.to_pylist(), term.to_pylist(), ends, ends[1:])}

    def lists(self, kind: int, terms: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores or weights, inverse frequencies) of the rows that have terms, one after the other."""
        if not (own := [(got, w) for t, w in zip(terms, terms if weights is None else weights) if (got := self.of.get((kind, t)))]):
            return np.zeros(0, int), np.zeros(0), np.zeros(0)
        return np.concatenate([x[0] for x, _ in own]), np.concatenate([x[1] for x, _ in own] if weights is None else [np.full(len(x[0]), w) for x, w in own]), np.concatenate([x[2] for x, _ in own])

    def summed(self, kind: int, terms: list[str], what: int) -> np.ndarray:
        """By row: the sum of the scores (1), inverse frequencies (2), or the number (0) of the terms that it has."""
        if not (own := [got for t in terms if (got := self.of.get((kind, t)))]):
            return np.zeros(len(self.keys))
        return np.bincount(np.concatenate([x[0] for x in own]), np.concatenate([x[what] for x in own]) if what else None, len(self.keys)).astype(float, copy=False)

    def placed(self, at: np.ndarray, *lists: tuple) -> list[tuple]:
        """lists() of the rows at, whose places are those in at."""
        to = np.full(len(self.keys), -1)
        to[at] = np.arange(len(at))
        out = []
        for x in lists:
            own = to[x[0]]
            keep = np.flatnonzero(own >= 0)
            out.append((own[keep], *(v[keep] for v in x[1:])))
        return out

    def best(self, extra: list[dict]) -> np.ndarray:
        """By row: the greatest boost of a token that it holds."""
        out = np.zeros(len(self.keys))
        for x in extra:
            if (TOKEN, x["token"]) in self.of:
                at = self.of[TOKEN, x["token"]][0]
                out[at] = np.maximum(out[at], x["boost"])
        return out

    def touches(self, q: Query) -> bool:
        return any((k, t) in self.of for t in q[1] for k in (CONTENT, METADATA)) or any((TOKEN, x["token"]) in self.of for x in q[4].get("extra") or ())


def _queries(rows: pa.StructArray) -> list[Query]:
    return [(x["query_id"], [t["term"] for t in x["terms"]], np.array([t["weight"] for t in x["terms"]]), np.array([t["numeric"] for t in x["terms"]], bool), x) for x in rows.to_pylist()]


def met(rows: DataFrame, queries: DataFrame, found: Callable[[Block, Query], dict[str, np.ndarray] | None], columns: dict[str, str], id_type: DataType) -> DataFrame:
    """(query_id, *columns) of what found() gives for each block of packed_rows() and query of packed_queries(): arrays of equal length, by column."""
    names = list(columns)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_type)

        def batch(ids: list, ns: list[int], parts: list[dict]) -> pa.RecordBatch:
            own = pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), ns)))
            return pa.RecordBatch.from_arrays([own, *[pa.array(np.concatenate([p[c] for p in parts]), kinds[columns[c]]) for c in names]], names=["query_id", *names])

        known: list[tuple] = []  # the same queries come with block after block
        for b in batches:
            for i in range(b.num_rows):
                block, ids, ns, parts = Block(b.column(0)[i].values, b.column(1)[i].values), [], [], []
                asked = b.column(2)[i].values
                if not (own := next((qs for a, qs in known if a.equals(asked)), None)):
                    own = _queries(asked)
                    known = [*known[-3:], (asked, own)]
                for q in own:
                    if not block.touches(q) or not (got := found(block, q)) or not len(got[names[0]]):
                        continue
                    ids.append(q[0])
                    parts.append(got)
                    ns.append(len(got[names[0]]))
                    if sum(ns) >= AT_ONCE:
                        yield batch(ids, ns, parts)
                        ids, ns, parts = [], [], []
                if ids:
                    yield batch(ids, ns, parts)

    return rows.crossJoin(queries).mapInArrow(run, f"query_id {id_type.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def greatest(rows: DataFrame, queries: DataFrame, id_type: DataType) -> DataFrame:
    """(query_id, most): the greatest sum of scores that a row has for each query."""
    def found(b: Block, q: Query) -> dict | None:
        most = b.summed(CONTENT, q[1], 1).max()
        return {"most": np.array([most])} if most > 0 else None

    return met(rows, queries, found, {"most": "double"}, id_type).groupBy("query_id").agg(F.max("most").alias("most"))


def scores(b: Block, q: Query, at: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The columns of Index.scored() for the rows at, which the query reaches, or all that it does."""
    x, share = q[4], lambda a, total: a / total if total and total > 0 else np.zeros(len(a))
    content, named, semantic = b.lists(CONTENT, q[1]), b.lists(METADATA, q[1], q[2]), b.best(x["extra"]) if x.get("extra") else np.zeros(len(b.keys))
    numbers = [t for t, n in zip(q[1], q[3]) if n]
    if at is None:
        reached = semantic > 0
        reached[content[0]] = reached[named[0]] = True
        at = np.flatnonzero(reached)
    content, named = b.placed(at, content, named)
    of = lambda own, what: np.bincount(own[0], own[what] if what else None, len(at))
    groups, meta, semantic = of(content, 0), of(named, 1), semantic[at]
    all_numbers = (b.summed(METADATA, numbers, 0) == len(numbers))[at] if len(numbers) >= 3 else np.zeros(len(at), bool)
    tier = np.where(all_numbers, 0, np.where((groups > 0) | (meta > 0), 1, 2))
    lexical = np.minimum(np.maximum(0.72 * share(of(content, 1), x["most"]) + 0.28 * share(of(content, 2), x["total_idf"]), 0.0), 1.0)
    metadata = share(meta, x["total"])
    return {"chunk_id": b.keys[at], "lexical": lexical, "coverage": np.minimum(groups / max(len(q[1]), 1), 1.0), "metadata": metadata, "semantic": semantic, "tier": tier, "prefilter": 0.8 * lexical + 0.4 * metadata + 0.1 * semantic}


def grades(b: Block, q: Query) -> np.ndarray:
    """By row: what orders a query's rows by tier, then prefilter, but for the order of sums; over 0 where the query reaches the row."""
    x, part = q[4], lambda share, total: share / total if total and total > 0 else 0.0
    if x.get("extra") or q[3].sum() >= 3:
        s, out = scores(b, q), np.zeros(len(b.keys))
        out[np.searchsorted(b.keys, s["chunk_id"])] = s["prefilter"] + 4.0 * (2 - s["tier"])
        return out
    # All are of tier 1; shares that are clamped pass 1 by rounding only.
    content, named = b.lists(CONTENT, q[1]), b.lists(METADATA, q[1], q[2] * (0.4 * part(1.0, x["total"])))
    each = content[1] * (0.8 * 0.72 * part(1.0, x["most"])) + content[2] * (0.8 * 0.28 * part(1.0, x["total_idf"]))
    return np.bincount(np.concatenate([content[0], named[0]]), np.concatenate([each, named[1]]), len(b.keys))


SCORED = {"chunk_id": "bigint", "lexical": "double", "coverage": "double", "metadata": "double", "semantic": "double", "tier": "int", "prefilter": "double"}


SHARED = SCORED | {"written_share": "double", "word_share": "double"}


def shared(b: Block, q: Query, at: np.ndarray) -> dict[str, np.ndarray]:
    """scores() with the shares of a query's terms that the metadata have: as written, where numbers count 2.5 times, and folded."""
    numbers = [t for t, n in zip(q[1], q[3]) if n]
    of = lambda kind, terms: b.summed(kind, terms, 0)[at] if terms else np.zeros(len(at))
    n = max(len(q[1]), 1)
    return scores(b, q, at) | {"written_share": (of(WRITTEN, q[1]) + 1.5 * of(WRITTEN, numbers)) / (n + 1.5 * len(numbers)), "word_share": of(METADATA, q[1]) / n}


def all_scores(rows: DataFrame, queries: DataFrame, id_type: DataType, only: tuple = tuple(SCORED)) -> DataFrame:
    return met(rows, queries, scores, {c: t for c, t in SCORED.items() if c in only}, id_type)


def best_scores(rows: DataFrame, queries: DataFrame, n: int, limit: int, id_type: DataType, scores: Callable = scores, columns: dict[str, str] = SCORED, grades: Callable = grades) -> DataFrame:
    """Of what scores() gives (columns) the rows that may be among each query's best limit; those are all there, and few others. grades()
    gives what they are ordered by, for all rows of a block.

    First each block tells the grades at a few of its ranks. From these it is known of some grade that limit rows reach it; then only
    rows that reach it leave their blocks. Grades within MARGIN count as equal. n: how many rows there are, about.
    """
    each = max(1, limit * ROWS // max(n, 1) // 4)
    ranks = sorted({min(limit, k) for k in (each, 2 * each, 4 * each, 8 * each, 16 * each, limit)})

    def highest(g: np.ndarray) -> np.ndarray:
        """The limit highest grades, in order, without rows that are not reached."""
        top = np.sort(np.partition(g, len(g) - limit)[len(g) - limit:] if len(g) > limit else g)
        return top[top > 0][::-1]

    def told(b: Block, q: Query) -> dict | None:
        g = highest(grades(b, q))
        own = [k for k in ranks if k <= len(g)]
        return {"grade": g[np.array(own) - 1], "rows": np.diff([0, *own])} if own else None

    w = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    t = met(rows, queries, told, {"grade": "double", "rows": "int"}, id_type).withColumn("upto", F.sum("rows").over(w))
    bound = t.filter(F.col("upto") >= limit).groupBy("query_id").agg(F.max("grade").alias("bound"))
    q = cut(queries.select(F.explode("queries").alias("q")).select("q.*").join(bound, "query_id", "left"), "bounds")

    def best(b: Block, q: Query) -> dict | None:
        g, least = grades(b, q), q[4]["bound"]
        at = np.flatnonzero(g >= least - MARGIN if least is not None and least > MARGIN else g > 0)
        if len(at) > limit:
            at = at[g[at] >= highest(g[at])[-1] - MARGIN]
        return scores(b, q, at) if len(at) else None

    return met(rows, packed_queries(q, q.count()), best, columns, id_type)


def fielded_grades(b: Block, q: Query) -> np.ndarray:
    """By row with a term of the query: the sum of their scores, and 1.5 if its metadata have all of them."""
    groups = b.summed(CONTENT, q[1], 0)
    return np.where(groups > 0, b.summed(CONTENT, q[1], 1) + np.where(b.summed(METADATA, q[1], 0) == len(q[1]), 1.5, 0.0), 0.0)


def fielded(b: Block, q: Query, at: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc_id": b.keys[at], "score": fielded_grades(b, q)[at]}


def boosted(b: Block, q: Query) -> dict[str, np.ndarray]:
    """Of each row that holds a token with a boost the greatest of them."""
    s = b.best(q[4]["extra"])
    at = np.flatnonzero(s > 0)
    return {"chunk_id": b.keys[at], "semantic": s[at]}


def counts(rows: DataFrame, queries: DataFrame, id_type: DataType) -> DataFrame:
    """(query_id, key, content, meta, n): how many of the query's n terms a row holds, and its metadata, where there is one."""
    def found(b: Block, q: Query) -> dict | None:
        c, m = b.summed(CONTENT, q[1], 0), b.summed(METADATA, q[1], 0)
        at = np.flatnonzero((c > 0) | (m > 0))
        return {"key": b.keys[at], "content": c[at].astype(np.int32), "meta": m[at].astype(np.int32), "n": np.full(len(at), len(q[1]), np.int32)}

    return met(rows, queries, found, {"key": "bigint", "content": "int", "meta": "int", "n": "int"}, id_type)
