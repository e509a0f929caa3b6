"""One object for the usual calls: import, query, page, status, sync, learn. Every call takes and gives DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, chunking, graph, retrieval, spectral, sync, vectors
from corpusloom.session import cut
from corpusloom.sources import convert

DOCUMENT = "doc_id bigint, source_path string, title string, text string"
INDEX = ("chunks", "post", "meta", "terms", "profile")


class Engine:
    """Documents (doc_id, source_path, title, text) and their index in generations under root; readers see the whole of the newest one.

    A generation adds only what is new: rows carry its number (gen), and `gone` says of a document that its rows of earlier
    generations count no more. So a new document costs what it is itself, not what the store holds. compact() writes the store anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._index: tuple[int, retrieval.Index] | None = None
        self._model: tuple[int, spectral.Model | None] | None = None

    def _generation(self) -> int:
        return sync.state(self.spark, self.root)["generation"]

    def _live(self, name: str) -> DataFrame | None:
        df, gone = (sync.published(self.spark, self.root, n) for n in (name, "gone"))
        if df is None or gone is None:
            return df
        dead = gone.groupBy("doc_id").agg(F.max("gen").alias("_dead"))
        if "doc_id" in df.columns:
            j = df.join(dead, "doc_id", "left")
        else:
            j = df.withColumn("doc_id", retrieval.document_of()).join(dead, "doc_id", "left").drop("doc_id")
        return j.filter("_dead is null or gen >= _dead").drop("_dead").select(*df.columns)

    def documents(self) -> DataFrame:
        found = self._live("documents")
        return found.drop("gen") if found is not None else self.spark.createDataFrame([], DOCUMENT)

    def ingest(self, docs: DataFrame) -> int:
        """Add documents; those of a path or id already known are replaced. The new generation's number."""
        new = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source_path", "title", "text"), "documents")
        old = self.documents().select("doc_id", "source_path")
        gone = old.join(new.select("source_path").distinct(), "source_path", "left_semi").select("doc_id").unionByName(old.join(new.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")).distinct()
        return self._publish(new, gone)

    def import_files(self, root: str, ignore: list[str] | None = None) -> int:
        """sync() with the files under a folder, see convert.read_documents(); ids are made of the paths."""
        d = convert.read_documents(self.spark, root, ignore).filter("text is not null")
        # 38 bits, as chunk numbers take the rest; of two paths with the same id neither is read.
        d = d.withColumn("doc_id", F.shiftrightunsigned(F.xxhash64("source_path"), 26))
        same = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
        if same:
            raise ValueError("two paths have the same id; give ids of your own to sync()")
        prefix = d.select(F.min("source_path")).first()[0]
        return self.sync(d, root.rstrip("/") if prefix is None or prefix.startswith(root) else root.replace("file://", "file:").rstrip("/"))

    def sync(self, docs: DataFrame, root: str) -> int:
        """Make the documents under a folder exactly docs; all others stay. Only documents that are new or whose title or text changed are
        written; if none is and none is missing, nothing is, and the generation stays."""
        inside = sync.belongs(F.col("source_path"), F.lit("folder"), F.lit(root))
        named = lambda df: df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source_path", "title", "text").withColumn("hash", sync.row_hash(["title", "text"]))
        old, new = named(self.documents().filter(inside)).select("doc_id", "source_path", "hash"), cut(named(docs), "documents")
        change = cut(sync.manifest_diff(old, new.select("doc_id", "source_path", "hash"), ["doc_id", "source_path"], ["hash"]).filter("change <> 'unchanged'"), "changes")
        if change.isEmpty():
            return self._generation()
        fresh = new.join(change.filter("change in ('added', 'modified')").select("doc_id", "source_path"), ["doc_id", "source_path"], "left_semi").drop("hash")
        return self._publish(fresh.select("doc_id", "source_path", "title", "text"), change.filter("change in ('removed', 'modified')").select("doc_id").distinct())

    def _publish(self, docs: DataFrame, gone: DataFrame) -> int:
        n = F.lit(sync.next_generation(self.spark, self.root))
        gone = cut(gone, "gone")
        parts = {k: cut(df, k) for k, df in retrieval.Index.tables(cut(chunking.chunks(docs, None).drop("token_count"), "chunks")).items()}
        counts = retrieval.Index.counted(parts["post"])
        post = self._live("post")
        if post is not None:
            lost = post.join(gone.withColumnRenamed("doc_id", "_d"), retrieval.document_of() == F.col("_d"), "left_semi")
            counts = counts.unionByName(retrieval.Index.counted(lost).select("token", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        return sync.publish(self.spark, self.root, {"documents": docs.withColumn("gen", n), "gone": gone.withColumn("gen", n), "vocab": counts, **{k: df.withColumn("gen", n) for k, df in parts.items()}}, added=True)

    def compact(self) -> int:
        """Write what counts of all generations as one."""
        live = {k: self._live(k) for k in ("documents", *INDEX)}
        if live["documents"] is None:
            return 0
        none = live["documents"].select("doc_id", "gen").limit(0)
        return sync.publish(self.spark, self.root, {**live, "vocab": retrieval.Index.counted(live["post"]), "gone": none})

    def index(self) -> retrieval.Index:
        n = self._generation()
        if self._index is None or self._index[0] != n:
            if n == 0 or self._live("post") is None:
                self._index = (n, retrieval.Index.build(chunking.sections(self.documents())))
            else:
                vocab = sync.published(self.spark, self.root, "vocab").groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
                self._index = (n, retrieval.Index.over({k: self._live(k).drop("gen") for k in INDEX} | {"vocab": vocab}))
        return self._index[1]

    def links(self) -> DataFrame:
        return graph.edges(graph.resolved_links(self.documents()))

    def learn(self, components: int | None = None) -> DataFrame:
        """Learn the vectors of tokens from the whole store and publish them; until the next learn() they serve the documents there are then.
        (component, eigenvalue, token, value)."""
        cooc = cut(vectors.cooccurrence(self.index().chunks).withColumn("w", F.round("w", 9)), "cooccurrence")
        pairs = cut(vectors.eigenpairs(cooc, components, spectral.CAP), "eigenpairs")
        sync.publish(self.spark, self.root, {"cooccurrence": cooc, "eigenpairs": pairs})
        return pairs

    def model(self) -> spectral.Model | None:
        """What learn() published last; None before the first. Chunks and documents are projected once a generation."""
        n = self._generation()
        if self._model is None or self._model[0] != n:
            cooc, pairs = (sync.published(self.spark, self.root, t) for t in ("cooccurrence", "eigenpairs"))
            self._model = (n, spectral.of(cooc, pairs).with_texts(self.index().chunks) if pairs is not None else None)
        return self._model[1]

    def query(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, doc_id, source_path, score, confidence, rank) for a batch (query_id, query_text), with the documents' links and, after learn(),
        learned vectors; top_k from 1 to 20, of a query's text the first 2,000 characters."""
        q = queries.select("query_id", F.substring("query_text", 1, 2_000).alias("query_text"))
        return self.index().ranked_documents(q, max(1, min(top_k, 20)), self.model(), cut(self.links(), "links"))

    def search(self, queries: DataFrame, top_k: int = 5, most: int = 1_200) -> DataFrame:
        """(query_id, source_path, rank, score, content, chunk_index): what is shown of each document, of most characters (80 to 4,000) at most."""
        ix, q, k = self.index(), cut(queries, "queries"), max(1, min(top_k, 20))
        shown = answers.rendered_results(ix.bundles(q, k), ix.chunks.select(retrieval.chunk_id(), "content", "chunk_index"), ix.ranked_documents(q, k))
        return shown.withColumn("content", T.truncated(F.col("content"), max(80, min(most, 4_000))))

    def answer(self, queries: DataFrame) -> DataFrame:
        """(query_id, place, source_path, sentence)."""
        best = self.query(queries, 5).select("query_id", "doc_id", "source_path", "score", "rank")
        return answers.selected_sentences(best.join(self.documents().select("doc_id", "text"), "doc_id").join(queries, "query_id"))

    def answer_text(self, queries: DataFrame) -> DataFrame:
        """(query_id, answer, confidence) for every query, also those without a term or a result."""
        q = cut(queries, "queries")
        best = cut(self.query(q, 5), "ranked")
        e = cut(best.select("query_id", "doc_id", "source_path", "score", "rank").join(self.documents().select("doc_id", "text"), "doc_id").join(q, "query_id"), "evidence")
        return answers.answer_texts(q, best, answers.selected_sentences(e), answers.concepts(e), e)

    def document(self, source_path: str, offset: int = 0, limit: int = 4_000) -> DataFrame:
        """(doc_id, page) of one document by its exact path; see T.page()."""
        return self.documents().filter(F.col("source_path") == source_path).select("doc_id", T.page(F.col("text"), F.lit(offset), F.lit(limit)).alias("page"))

    def status(self) -> DataFrame:
        """One row: documents, characters, generation, and whether vectors have been learned."""
        state = sync.state(self.spark, self.root)
        return self.documents().agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).withColumns(
            {"generation": F.lit(state["generation"]), "learned": F.lit("eigenpairs" in state["tables"])})
