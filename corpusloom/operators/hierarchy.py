"""Parent-child rows to full hierarchies by pointer doubling.

Round k joins every unresolved node with the row of the ancestor it points at, so that the distance it spans doubles. A tree
of depth d needs log2(d) + 1 rounds. Only unresolved nodes are joined and written again. The looked-up side has one row a
node, so a hot ancestor is skew of one side only, which adaptive execution splits.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import salted_join
from corpusloom.session import cut


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """The written table of each round (k, n, anc, dist, done), and the nodes that lie on cycles, if any.

    In round i an unresolved node points at the ancestor 2^i above it; a done one at its root.
    """
    up = nodes.select("k", F.col("n").alias("p"))
    has = nodes.filter("p is not null").join(up.withColumn("has", F.lit(True)), ["k", "p"], "left")
    start = nodes.filter("p is null").withColumn("has", F.lit(None).cast("boolean")).unionByName(has).select(
        "k", "n", F.when(F.col("has"), F.col("p")).otherwise(F.col("n")).alias("anc"),
        F.when(F.col("has"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("dist"), F.col("has").isNull().alias("done"),
    )
    rounds, before = [cut(start, "hierarchy")], -1
    ended_all = rounds[0].filter("done")  # what is done stands in one table at a time, so that a round reads each node once
    while True:
        last = rounds[-1].filter("not done")
        look = ended_all.unionByName(last).select("k", F.col("n").alias("anc"), F.col("anc").alias("to"), F.col("dist").alias("more"), F.col("done").alias("ends"))
        step = last.join(look, ["k", "anc"]).select("k", "n", F.col("to").alias("anc"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ends").alias("done"))
        rounds.append(now := cut(step, "hierarchy"))
        left, ended, places = now.agg(
            F.count(F.when(~F.col("done"), 1)), F.count(F.when(F.col("done"), 1)),
            F.count_distinct(F.when(~F.col("done"), F.struct("k", "anc"))),
        ).first()
        if not left:
            return rounds, None
        # No tree node is left when a round ends none. What is left runs into cycles; the places reached shrink until they are
        # the cycles alone, for on these the jump is one to one.
        if not ended and places == before:
            return rounds, now.filter("not done").select("k", F.col("anc").alias("n")).distinct()
        before = places if not ended else -1
        ended_all = ended_all.unionByName(now.filter("done"))


#: Levels of a tree that are one block; a path is put together from those of blocks.
BLOCK = 16


def _paths(tree: DataFrame, deepest: int) -> DataFrame:
    """(k, n, path) of the nodes (k, n, p, d, seg) of trees: the names above each from the root on; d is the depth, seg the names from p
    (itself too) to n (not itself).

    Doubling pointers carry the path within a block of levels only. The nodes at the tops of blocks form trees of a sixteenth of the
    depth, with the paths between them as segments, and get their paths in the same way; each node then takes that of the top above it.
    So a long path is moved for one node in sixteen, and once for the others, into the result.
    """
    o = F.col("d") % BLOCK
    now = cut(tree.select("k", "n", o.alias("o"), F.when(o == 0, F.col("n")).otherwise(F.col("p")).alias("anc"),
                          F.when(o == 0, F.array().cast("array<string>")).otherwise(F.col("seg")).alias("path")), "blocks")
    reach = 1
    while reach < min(BLOCK, deepest + 1) and reach < BLOCK - 1:
        above = now.select("k", F.col("n").alias("anc"), F.col("anc").alias("to"), F.col("path").alias("above"))
        step = now.filter(F.col("o") > reach).join(above, ["k", "anc"]).select("k", "n", "o", F.col("to").alias("anc"), F.concat("above", "path").alias("path"))
        now = cut(now.filter(F.col("o") <= reach).unionByName(step), "blocks")
        reach *= 2
    if deepest < BLOCK:
        return now.select("k", "n", "path")
    under = now.select("k", F.col("n").alias("p"), "anc", "path")
    tops = tree.filter((F.col("d") > 0) & (o == 0)).select("k", "n", "p", "d").join(under, ["k", "p"]).select(
        "k", "n", F.col("anc").alias("p"), (F.col("d") / BLOCK).cast("bigint").alias("d"), F.concat("path", F.array("p")).alias("seg"))
    roots = tree.filter("d = 0").select("k", "n", "p", "d", "seg")
    known = cut(_paths(cut(roots.unionByName(tops), "tops"), deepest // BLOCK), "tops").select("k", F.col("n").alias("anc"), F.col("path").alias("above"))
    # A top may have a third of all nodes below it.
    rows = now.groupBy("k", "anc").agg(F.count(F.lit(1)).alias("rows"))
    return salted_join(now.select("k", "n", "anc", "path"), known.join(rows, ["k", "anc"]), ["k", "anc"], "rows", now.count()).select("k", "n", F.concat("above", "path").alias("path"))


def clean_edges(df: DataFrame, node: str, parent: str, key: list[str], version: str | None = None) -> DataFrame:
    """One row (k, n, p) a node: of its newest version, at ties the greatest parent. Rows with a null key or node name no node."""
    v = F.col(version) if version else F.lit(None).cast("string")
    k = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, node]])
    return (df.filter(ok).groupBy(k.alias("k"), F.col(node).cast("string").alias("n"))
            .agg(F.max(F.struct(v.alias("v"), F.col(parent).cast("string").alias("p"))).alias("m")).select("k", "n", F.col("m.p").alias("p")))


def _unpack(df: DataFrame, key: list[str], node: str) -> list[Column]:
    return [*(F.col(f"k.k{i}").alias(c) for i, c in enumerate(key)), F.col("n").alias(node)]


def cycle_nodes(df: DataFrame, node: str, parent: str, key: list[str], version: str | None = None) -> DataFrame:
    """(*key, node) of every node from which following parent leads back to itself.

    Empty input gives no row; a node that is its own parent is a cycle of one; nodes below a cycle are not named.
    """
    _, cycles = _rounds(cut(clean_edges(df, node, parent, key, version), "edges"))
    if cycles is None:
        return df.select(*[F.col(c) for c in key], F.col(node).cast("string").alias(node)).limit(0)
    return cycles.select(*_unpack(cycles, key, node))


def hierarchy(df: DataFrame, node: str, parent: str, key: list[str], version: str | None = None, current: str | None = None) -> DataFrame:
    """A row for each node: (*key, node, parent, root, depth, path, n_descendants, in_cycle, below_cycle, on_current_branch).

    path holds the names from the root to the node. A parent without a row makes its child a root (parent keeps the name).
    Nodes on or below a cycle have null root, depth, path and n_descendants. current names the column that holds, in each row
    of a key, the node whose branch is to be marked (the greatest, if rows differ); null or unknown marks none.
    """
    edges = cut(clean_edges(df, node, parent, key, version), "edges")
    rounds, cycles = _rounds(edges)
    ended = reduce(DataFrame.unionByName, [r.filter("done") for r in rounds]).select("k", "n", "anc", "dist")
    tree = cut(edges.join(ended, ["k", "n"]), "tree")
    deepest = tree.agg(F.max("dist")).first()[0] or 0
    # Descendants: those nearer than 2^(k+1) are those nearer than 2^k of the node itself and of each node 2^k below it.
    count = ended.select("k", "n", F.lit(1).cast("long").alias("c"))
    for i, r in enumerate(rounds):
        if 2**i > deepest:
            break
        below = r.filter((F.col("dist") == 2**i) & (F.col("dist") > 0)).select("k", "n", "anc").join(count, ["k", "n"])
        more = below.groupBy("k", F.col("anc").alias("n")).agg(F.sum("c").alias("more"))
        count = cut(count.join(more, ["k", "n"], "left").select("k", "n", (F.col("c") + F.coalesce("more", F.lit(0))).alias("c")), "descendants")
    mark = edges.select("k", "n").limit(0)
    if current:
        # The branch of the current node: it, and what stands 2^k above each node of the branch found so far, for each k.
        k = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
        names = df.filter(F.col(current).isNotNull()).groupBy(k.alias("k")).agg(F.max(F.col(current).cast("string")).alias("n"))
        mark = cut(ended.select("k", "n").join(names, ["k", "n"], "left_semi"), "branch")
        for i, r in enumerate(rounds):
            if 2**i > deepest:
                break
            mark = cut(mark.unionByName(r.filter(F.col("dist") == 2**i).join(mark, ["k", "n"], "left_semi").select("k", F.col("anc").alias("n"))).distinct(), "branch")
    on = cycles.withColumn("cyc", F.lit(True)) if cycles is not None else edges.select("k", "n").limit(0).withColumn("cyc", F.lit(True))
    out = edges.join(ended, ["k", "n"], "left").join(count, ["k", "n"], "left").join(on, ["k", "n"], "left").join(mark.withColumn("mark", F.lit(True)), ["k", "n"], "left")
    seg = F.when(F.col("dist") > 0, F.array("p")).otherwise(F.array().cast("array<string>"))
    path = _paths(tree.select("k", "n", "p", F.col("dist").alias("d"), seg.alias("seg")), deepest)
    out = out.join(path, ["k", "n"], "left")
    return out.select(
        *_unpack(out, key, node), F.col("p").alias(parent), F.col("anc").alias("root"), F.col("dist").alias("depth"),
        F.when(F.col("dist").isNotNull(), F.concat("path", F.array("n"))).alias("path"), (F.col("c") - 1).alias("n_descendants"), F.coalesce("cyc", F.lit(False)).alias("in_cycle"),
        (F.col("dist").isNull() & F.col("cyc").isNull()).alias("below_cycle"), F.coalesce("mark", F.lit(False)).alias("on_current_branch"),
    )


def descendants(tree: DataFrame, node: str, key: list[str]) -> DataFrame:
    """Each pair (*key, ancestor, node, distance) of the rows of hierarchy(); as rows, so that no root gathers an array."""
    return tree.filter("path is not null").select(*key, F.posexplode("path").alias("at", "ancestor"), F.col(node), "depth").filter("at < depth").select(
        *key, "ancestor", node, (F.col("depth") - F.col("at")).alias("distance"))


def first_child_threads(df: DataFrame, node: str, parent: str, key: list[str], version: str | None = None) -> DataFrame:
    """(*key, node, place) of the thread of each root: the root, then always the first child by name; place is the depth."""
    edges = cut(clean_edges(df, node, parent, key, version), "edges")
    known = edges.select("k", F.col("n").alias("p"))
    child = edges.filter("p is not null").join(known, ["k", "p"], "left_semi")
    first = child.groupBy("k", "p").agg(F.min("n").alias("n")).withColumn("first", F.lit(True))
    has = child.select("k", "n", F.lit(True).alias("has"))
    tree = edges.join(has, ["k", "n"], "left").join(first, ["k", "n", "p"], "left")
    # Later children are made roots of their own, so that only true roots' trees hold the threads.
    alone = cut(tree.select("k", "n", F.when(F.col("first"), F.col("p")).alias("p"), F.col("has").isNull().alias("top")), "edges")
    rounds, _ = _rounds(alone.select("k", "n", "p"))
    ended = reduce(DataFrame.unionByName, [r.filter("done") for r in rounds])
    top = alone.filter("top").select("k", F.col("n").alias("anc"))
    t = ended.join(top, ["k", "anc"], "left_semi")
    return t.select(*_unpack(t, key, node), F.col("dist").alias("place"))
