"""Learned vectors of tokens: what a query's words are like, and how texts stand to them.

The vectors are the rows of the leading eigenvectors of the co-occurrence among at most CAP tokens, so they are of bounded size
whatever the corpus: at most 10,000 rows of 32 numbers, 2.5 MB. They are sent to every executor, and each block of queries or
chunks is multiplied with all of them there.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import vectors
from corpusloom.session import cut

CAP = 10_000
LEAST = 0.05


def coherence(values: np.ndarray) -> float:
    """How far the largest eigenvalue stands out from the second: (l1 - l2) / l1; 0 without two, or if the first is 0."""
    v = np.sort(np.asarray(values, float))[::-1]
    return float((v[0] - v[1]) / v[0]) if len(v) > 1 and abs(v[0]) > 1e-10 else 0.0


def matrix_confidence(coherent: float, cells: int) -> float:
    """coherence times the root of log10(cells) / 3, both held between 0 and 1."""
    size = min(max(np.log10(cells) / 3, 0.0), 1.0) if cells > 0 else 0.0
    return float(min(max(coherent, 0.0), 1.0) * np.sqrt(size))


def singular(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and left vectors of a small or dense matrix; each vector's largest entry is positive."""
    a = np.zeros((n, n))
    np.add.at(a, (rows, cols), w)
    u, s, _ = np.linalg.svd(a)
    u = u[:, :k] * np.where(np.take_along_axis(u[:, :k], np.abs(u[:, :k]).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    return s[:k], u


def solved(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors: those of the identity if there are fewer than ten cells, by Lanczos for a large sparse matrix, else by SVD."""
    if len(w) < 10:
        return np.ones(min(k, n)), np.eye(n)[:, : min(k, n)]
    if n >= 1000 and len(w) / (n * n) < 0.05:
        return vectors.lanczos(rows, cols, w, n, k)
    return singular(rows, cols, w, n, k)


def updated(values: np.ndarray, basis: np.ndarray, rows: np.ndarray, cols: np.ndarray, w: np.ndarray, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors, drift) after cells (rows, cols, w) have been added to a symmetric matrix known by its leading eigenpairs.

    The update is projected on the space of the old vectors and of what it adds to them (orthonormalised), and the small matrix is
    solved anew. drift: one less the mean size of the cosines between old and new vectors.
    """
    n, k = basis.shape
    delta = lambda v: np.stack([np.bincount(rows, weights=rate * w * v[cols, j], minlength=n) for j in range(v.shape[1])], axis=1)
    extra = delta(basis)
    extra = extra - basis @ (basis.T @ extra)
    q, r = np.linalg.qr(extra)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    wide = np.hstack([basis, q])
    small = wide.T @ (basis * values) @ (basis.T @ wide) + wide.T @ delta(wide)
    lam, vec = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(lam)[::-1][:k]
    new = wide @ vec[:, top]
    sign = np.where((new * basis).sum(axis=0) < 0, -1.0, 1.0)
    new *= sign
    return lam[top], new, float(1 - np.abs((new * basis).sum(axis=0)).mean())


def drift(w: Column, v: Column) -> Column:
    """Frobenius norm of the difference of two matrices whose cells have been joined; a missing cell is 0."""
    return F.sqrt(F.sum(F.pow(F.coalesce(w, F.lit(0.0)) - F.coalesce(v, F.lit(0.0)), 2)))


@dataclass
class Model:
    """token_vectors: (token, vec), CAP rows at most; values: the eigenvalues, largest first; cooc: (a, b, w) to expand queries with;
    cells: how many cells the matrix had; chunk_vectors: (chunk_id, vec); document_vectors: (doc_id, vec)."""

    token_vectors: DataFrame
    values: list[float]
    cooc: DataFrame
    cells: int
    chunk_vectors: DataFrame | None = None
    document_vectors: DataFrame | None = None
    _held: tuple | None = field(default=None, repr=False)

    @property
    def confidence(self) -> float:
        return matrix_confidence(coherence(np.array(self.values)), self.cells)

    def _matrix(self) -> tuple[list[str], np.ndarray]:
        if self._held is None:
            rows = self.token_vectors.orderBy("token").limit(CAP).collect()
            self._held = [r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), len(self.values))
        return self._held

    def _summed(self, rows: DataFrame, key: str, tokens: str) -> DataFrame:
        """(key, vec): the sum of the vectors of an array of tokens, brought to length 1; rows without a known token have none."""
        names, m = self._matrix()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(names, pa.string())
            for b in batches:
                flat, n = b.column(1).flatten().dictionary_encode(), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(flat.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[flat.indices.to_numpy(zero_copy_only=False)]
                row, own = np.repeat(np.arange(b.num_rows), n)[at >= 0], at[at >= 0]
                v = np.stack([np.bincount(row, m[own, j], b.num_rows) for j in range(m.shape[1])], axis=1) if m.shape[1] else np.zeros((b.num_rows, 0))
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.where(size > 1e-10, v / np.where(size > 1e-10, size, 1.0), v)
                has = np.flatnonzero(np.bincount(row, minlength=b.num_rows))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * v.shape[1], pa.int32()), pa.array(v[has].ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), flat], names=[key, "vec"])

        return rows.select(key, tokens).filter(F.col(tokens).isNotNull()).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vec array<double>")

    def projected(self, tokens: DataFrame) -> DataFrame:
        """(query_id, vec) of a batch's (query_id, token)."""
        return self._summed(tokens.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("ts")), "query_id", "ts")

    def top_tokens(self, tokens: DataFrame, top: int) -> DataFrame:
        """(query_id, token, score): the known tokens most like each query, scored by cosine times the first eigenvalue's share, LEAST at
        least; ties by token. Each block of queries is set against all token vectors."""
        names, m = self._matrix()
        total = float(np.sum(self.values))
        weight = self.values[0] / total if total > 1e-10 else 1.0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            for b in batches:
                for lo in range(0, len(b), 256):
                    part = b.iloc[lo : lo + 256]
                    q = np.array(part["vec"].tolist(), float)
                    s = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) @ unit.T * weight
                    rows = []
                    for k, scores in zip(part["query_id"], s):
                        good = np.flatnonzero(scores >= LEAST)
                        best = good[np.lexsort((good, -np.round(scores[good], 9)))[:top]]  # names are in order, so ties go by token
                        rows += [(k, names[i], float(scores[i])) for i in best]
                    yield pd.DataFrame(rows, columns=["query_id", "token", "score"])

        kind = tokens.schema["query_id"].dataType.simpleString()
        return self.projected(tokens).mapInPandas(run, f"query_id {kind}, token string, score double")

    def boosts(self, tokens: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, token, boost): what co-occurrence with the tokens most like a query adds, for tokens that the query does not have."""
        each = max(top_k, 32)
        pairs = vectors.best_pairs(self.cooc, self.top_tokens(tokens, each), self._matrix()[0], max(top_k, 10) * 8, each, LEAST)
        return vectors.token_boosts(pairs, tokens)

    def with_texts(self, chunks: DataFrame) -> "Model":
        """The model with the vectors of chunks (doc_id, chunk_index, content or ts), kept at 16 bits a number, and of documents, the mean of theirs."""
        rows = chunks.select((F.col("doc_id") * (1 << 24) + F.col("chunk_index")).alias("chunk_id"), vectors.words(chunks).alias("ts"))
        kept = F.transform(vectors.quantised(F.col("vec")), lambda x: x / 32767.0)
        c = cut(self._summed(rows, "chunk_id", "ts").select("chunk_id", kept.alias("vec")), "chunk-vectors")
        mean = vectors.mean_vectors(c.withColumn("doc_id", F.expr(f"chunk_id div {1 << 24}")), "doc_id", "vec")
        docs = mean.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("vec"))  # as many numbers as components
        return Model(self.token_vectors, self.values, self.cooc, self.cells, c, cut(docs, "document-vectors"), self._held)


def of(cooc: DataFrame, pairs: DataFrame) -> Model:
    """The model of a co-occurrence (a, b, w) and its eigenpairs (component, eigenvalue, token, value), without texts."""
    values = [r[0] for r in pairs.groupBy("component").agg(F.first("eigenvalue").alias("v")).orderBy("component").select("v").collect()]
    tokens = pairs.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda x: x["value"]).alias("vec"))
    return Model(cut(tokens, "token-vectors"), values, cooc, cooc.count())


def learned(chunks: DataFrame, k: int | None = None) -> Model:
    """The model of a corpus: see vectors.eigenpairs()."""
    cooc = cut(vectors.cooccurrence(chunks).withColumn("w", F.round("w", 9)), "cooccurrence")
    return of(cooc, cut(vectors.eigenpairs(cooc, k, CAP, written=True), "eigenpairs")).with_texts(chunks)
