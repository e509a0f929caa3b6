"""Links between documents, and walks over them, as joins; every walk has a fixed number of steps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.skew import split_cumulate
from corpusloom.session import cut

LINK, BACKLINK, RESTART, STEPS = 1.0, 0.35, 0.25, 3


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source_path", T.canonical_path(F.col("source_path")).alias("path"))


def suffixes(path: Column) -> Column:
    """All ends of a path that begin at a folder: a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))


def resolved_links(docs: DataFrame) -> DataFrame:
    """(doc_id, target, target_id) of each different link target in the documents' texts that is found, and to another document.

    A target is sought as the whole path, else beside the linking document, else as the end of exactly one path, else as the stem of
    exactly one file. Each step is a join on equal keys; of documents with one path the greatest id is taken.
    """
    keyed = _keyed(docs)
    links = docs.select("doc_id", "source_path", F.explode(T.wikilinks(F.col("text"))).alias("l")).select("doc_id", "source_path", F.col("l.target").alias("target")).distinct()
    folder = F.regexp_extract(T.canonical_path(F.col("source_path")), "^(.*)/[^/]*$", 1)
    wanted = links.withColumn("path", T.canonical_path(F.col("target"))).withColumn("beside", F.when(folder != "", F.concat(folder, F.lit("/"), "path")).otherwise(F.col("path")))
    exact = keyed.groupBy("path").agg(F.max("doc_id").alias("id"))
    ends = keyed.select("doc_id", F.explode(suffixes(F.col("path"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("id")).filter("n = 1")
    stems = docs.select(T.path_stem(F.col("source_path")).alias("stem"), "doc_id").groupBy("stem").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("id")).filter("n = 1")
    r = wanted.withColumn("stem", T.path_stem(F.col("target"))).join(exact.select("path", F.col("id").alias("a")), "path", "left").join(exact.select(F.col("path").alias("beside"), F.col("id").alias("b")), "beside", "left").join(
        ends.select("path", F.col("id").alias("c")), "path", "left").join(stems.select("stem", F.col("id").alias("d")), "stem", "left")
    return r.select("doc_id", "target", F.coalesce("a", "b", "c", "d").alias("target_id")).filter("target_id is not null and target_id <> doc_id")


def edges(links: DataFrame) -> DataFrame:
    """(src, dst, w): 1 along a link, .35 against it, the greater where both hold."""
    both = links.select(F.col("doc_id").alias("src"), F.col("target_id").alias("dst"), F.lit(LINK).alias("w")).unionByName(
        links.select(F.col("target_id").alias("src"), F.col("doc_id").alias("dst"), F.lit(BACKLINK).alias("w")))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def spread(edge: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, graph): where walks of three steps from each query's seeds (query_id, doc_id, score) end up.

    Each step restarts with .25; without neighbours the rest stays where it is. The best limit documents, as shares of the best.
    """
    s = seeds.filter("score > 0").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    total = s.groupBy("query_id").agg(F.sum("score").alias("total"))
    restart = cut(s.join(total, "query_id").select("query_id", "doc_id", (F.col("score") / F.col("total")).alias("mass")), "restart")
    share = cut(edge.join(edge.groupBy("src").agg(F.sum("w").alias("out")), "src").select(F.col("src").alias("doc_id"), "dst", (F.col("w") / F.col("out")).alias("p")), "share")
    now = restart
    for _ in range(STEPS):
        moved = now.join(share, "doc_id", "left").select("query_id", F.coalesce("dst", "doc_id").alias("doc_id"), (F.col("mass") * (1 - RESTART) * F.coalesce("p", F.lit(1.0))).alias("mass"))
        now = moved.unionByName(restart.withColumn("mass", F.col("mass") * RESTART)).groupBy("query_id", "doc_id").agg(F.sum("mass").alias("mass"))
    best = now.groupBy("query_id").agg(F.max("mass").alias("most"))
    w = Window.partitionBy("query_id").orderBy(-F.round("mass", 12), "doc_id")
    return now.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit).join(best, "query_id").select("query_id", "doc_id", (F.col("mass") / F.col("most")).alias("graph"))


def pagerank(nodes: DataFrame, links: DataFrame, steps: int = 20, damping: float = 0.85) -> DataFrame:
    """(doc_id, rank) over different links; what nodes without links hold is shared by all. Each step is written, so that a lost executor costs one step."""
    out = cut(links.select("doc_id", "target_id").distinct(), "links")
    degree = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    flow = cut(out.join(degree, "doc_id"), "flow")
    nodes = cut(nodes.select("doc_id").join(degree, "doc_id", "left"), "nodes")
    n = nodes.count()
    rank = nodes.select("doc_id", "degree", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(steps):
        lost = rank.filter("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = flow.join(rank.select("doc_id", "rank"), "doc_id").groupBy(F.col("target_id").alias("doc_id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        step = nodes.join(got, "doc_id", "left").select("doc_id", "degree", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        rank = cut(step, "pagerank")
    return rank.select("doc_id", "rank")


def orphans(docs: DataFrame, links: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source_path").join(links.select(F.col("target_id").alias("doc_id")), "doc_id", "left_anti")


def dead_links(docs: DataFrame) -> DataFrame:
    """(doc_id, target) of the links that lead nowhere, not even to the document itself."""
    keyed = _keyed(docs)
    links = docs.select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("l")).select("doc_id", F.col("l.target").alias("target")).distinct()
    stem = lambda c: F.lower(T.file_stem(T.canonical_path(c)))
    left = links.withColumn("path", T.canonical_path(F.col("target"))).join(keyed.select("path").distinct(), "path", "left_anti")
    return left.withColumn("stem", stem(F.col("target"))).join(docs.select(stem(F.col("source_path")).alias("stem")).distinct(), "stem", "left_anti").select("doc_id", "target")


def hub_pages(docs: DataFrame, most: int) -> DataFrame:
    """(folder, number, page, documents): pages of links for each folder, numbered from 1, of at most most documents each."""
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    line = F.concat(F.lit("- [["), F.regexp_replace("source_path", r"\.md$", ""), F.lit("|"), "title", F.lit("]]"))
    f = docs.filter(F.contains("source_path", F.lit("/"))).select(folder.alias("folder"), "doc_id", "source_path", F.coalesce("title", F.lit("")).alias("title"))
    f = f.select("folder", F.lower("title").alias("t"), "source_path", "doc_id", line.alias("line"), F.lit(1).cast("long").alias("one"))
    placed = split_cumulate(f, ["folder"], [F.col("t"), F.col("source_path"), F.col("doc_id")], "one", "place")
    g = placed.groupBy("folder", (F.floor(F.col("place") / most) + 1).alias("number")).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("a"))
    head = F.concat(F.lit("# "), "folder", F.when(F.col("number") > 1, F.concat(F.lit(" ("), "number", F.lit(")"))).otherwise(""), F.lit("\n\n"))
    return g.select("folder", "number", F.concat(head, F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("page"), F.size("a").cast("long").alias("documents"))
