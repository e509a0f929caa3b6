"""Queries of links, walks, co-occurrence and vectors."""

from pyspark.sql import functions as F

from corpusloom.operators import graph, retrieval, vectors
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import CHUNKS, RANK, chunks, index_for, r6
from corpusloom.plans.text_queries import CANON, LINKS, PSTEM, STEM, TOKENS, asked
from corpusloom.session import cut, table

#: Pages about regions, nations, customers and suppliers that link to each other, for what needs links that lead somewhere.
GEO = """documents AS (SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'geo/region/' || r_name || '.md' AS source_path, r_name AS title, '# ' || r_name AS text FROM region
    UNION ALL SELECT 100 + n_nationkey, 'geo/nation/' || n_name || '.md', n_name, '# ' || n_name || chr(10) || chr(10) || 'Part of [[region/' || r_name || '|the region]].' FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 1000 + c_custkey, 'geo/customer/' || c_name || '.md', c_name, '# ' || c_name || chr(10) || chr(10) || 'Lives in [[' || n_name || '#place]], buys [[' || c_mktsegment || ']].' FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 100000000 + s_suppkey, 'geo/nation/' || s_name || '.md', s_name, '# ' || s_name || chr(10) || chr(10) || 'Ships from [[' || n_name || ']].' FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
RESOLVED = GEO + "," + LINKS + f""",
keyed AS (SELECT doc_id, {CANON.format('source_path')} AS path, {PSTEM.format('source_path')} AS stem FROM documents),
want AS (SELECT DISTINCT l.doc_id, target, {CANON.format('target')} AS path, {PSTEM.format('target')} AS stem, k.path AS own FROM links l JOIN keyed k ON k.doc_id = l.doc_id),
exact AS (SELECT path, max(doc_id) AS id FROM keyed GROUP BY path),
ends AS (SELECT path, max(doc_id) AS id FROM (SELECT doc_id, array_to_string(p[k:], '/') AS path FROM (SELECT doc_id, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM keyed)) GROUP BY path HAVING count(*) = 1),
stems AS (SELECT stem, max(doc_id) AS id FROM keyed GROUP BY stem HAVING count(DISTINCT doc_id) = 1),
resolved AS (SELECT doc_id, target, target_id FROM (SELECT w.doc_id, target, coalesce(a.id, b.id, c.id, s.id) AS target_id FROM want w LEFT JOIN exact a ON a.path = w.path
    LEFT JOIN exact b ON b.path = CASE WHEN contains(own, '/') THEN regexp_replace(own, '/[^/]*$', '') || '/' || w.path ELSE w.path END
    LEFT JOIN ends c ON c.path = w.path LEFT JOIN stems s ON s.stem = w.stem) WHERE target_id IS NOT NULL AND target_id <> doc_id),
edge AS (SELECT src, dst, max(w) AS w FROM (SELECT doc_id AS src, target_id AS dst, 1.0 AS w FROM resolved UNION ALL SELECT target_id, doc_id, 0.35 FROM resolved) GROUP BY src, dst)"""


def pages(spark, d):
    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    n = n.join(r, n.n_regionkey == r.r_regionkey)

    def page(df, key, folder, name, *body):
        text = F.concat(F.lit("# "), F.col(name), *[F.lit(x) if isinstance(x, str) else x for x in body])
        return df.select(key.cast("bigint").alias("doc_id"), F.concat(F.lit(f"geo/{folder}/"), F.col(name), F.lit(".md")).alias("source_path"), F.col(name).alias("title"), text.alias("text"))

    return page(r, F.col("r_regionkey"), "region", "r_name").unionByName(
        page(n, 100 + F.col("n_nationkey"), "nation", "n_name", "\n\nPart of [[region/", F.col("r_name"), "|the region]].")).unionByName(
        page(c.join(n, c.c_nationkey == n.n_nationkey), 1000 + F.col("c_custkey"), "customer", "c_name", "\n\nLives in [[", F.col("n_name"), "#place]], buys [[", F.col("c_mktsegment"), "]].")).unionByName(
        page(s.join(n, s.s_nationkey == n.n_nationkey), 100_000_000 + F.col("s_suppkey"), "nation", "s_name", "\n\nShips from [[", F.col("n_name"), "]]."))


def links(spark, d):
    return graph.resolved_links(pages(spark, d))


@query("j08_link_resolution", f"WITH {RESOLVED} SELECT doc_id, target, target_id FROM resolved")
def j08(spark, d):
    return links(spark, d)


@query("g01_document_graph", f"WITH {RESOLVED} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM edge")
def g01(spark, d):
    return graph.edges(links(spark, d))


SEEDS = """seeds AS (SELECT query_id, chunk_id // 16777216 AS doc_id, max(0.75 * lexical + 0.10 * coverage) AS score FROM cand WHERE rank <= 64 GROUP BY ALL)"""


def seeds(spark, d):
    qs = cut(asked(spark, d), "queries")
    return retrieval.seed_scores(index_for(spark, d, qs).candidates(qs, 320))


@query("g02_seed_scores", f"WITH {RANK}, {SEEDS} SELECT query_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score FROM seeds")
def g02(spark, d):
    return r6(seeds(spark, d), "score")


_STEP = """m{n} AS (SELECT query_id, doc_id, sum(mass) AS mass FROM (SELECT m.query_id, coalesce(s.dst, m.doc_id) AS doc_id, m.mass * 0.75 * coalesce(s.p, 1) AS mass FROM m{o} m LEFT JOIN share s ON s.doc_id = m.doc_id
    UNION ALL SELECT query_id, doc_id, mass * 0.25 FROM m0) GROUP BY query_id, doc_id)"""


@query("g03_spread", f"""WITH {RESOLVED}, seeds AS (SELECT CAST(c_nationkey AS BIGINT) AS query_id, 1000 + c_custkey AS doc_id, c_acctbal / 10000 AS score FROM customer), share AS (SELECT e.src AS doc_id, dst, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY src) AS p FROM edge e),
m0 AS (SELECT query_id, doc_id, CAST(score AS DOUBLE) / sum(score) OVER (PARTITION BY query_id) AS mass FROM seeds WHERE score > 0), {', '.join(_STEP.format(n=n, o=n - 1) for n in (1, 2, 3))},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 12) DESC, doc_id) AS k, max(mass) OVER (PARTITION BY query_id) AS most FROM m3)
SELECT query_id, doc_id, CAST(round(mass / most, 6) AS DOUBLE) AS graph FROM k WHERE k <= 40""")
def g03(spark, d):
    rich = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("query_id"), (1000 + F.col("c_custkey")).alias("doc_id"), (F.col("c_acctbal") / 10000).alias("score"))
    return r6(graph.spread(graph.edges(links(spark, d)), rich, 40), "graph")


_LSTEM = "lower(" + STEM.format(CANON) + ")"


@query("g05_dead_links", f"""WITH {GEO}, {LINKS}, want AS (SELECT DISTINCT doc_id, target FROM links) SELECT doc_id, target FROM want w WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE {CANON.format('x.source_path')} = {CANON.format('w.target')})
AND NOT EXISTS (SELECT 1 FROM documents x WHERE {_LSTEM.format('x.source_path')} = {_LSTEM.format('w.target')})""")
def g05(spark, d):
    return graph.dead_links(pages(spark, d))


@query("g06_pagerank", f"""WITH RECURSIVE {RESOLVED}, lk AS MATERIALIZED (SELECT DISTINCT doc_id, target_id FROM resolved), deg AS MATERIALIZED (SELECT doc_id, count(*) AS degree FROM lk GROUP BY doc_id),
nd AS MATERIALIZED (SELECT doc_id FROM documents), cnt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nd),
pr AS (SELECT 0 AS step, doc_id, 1.0 / (SELECT n FROM cnt) AS rank FROM nd UNION ALL
    SELECT p.step + 1, nd.doc_id, 0.15 / (SELECT n FROM cnt) + 0.85 * (coalesce(g.got, 0) + p.lost / (SELECT n FROM cnt)) FROM nd
    CROSS JOIN (SELECT max(step) AS step, coalesce(sum(rank) FILTER (doc_id NOT IN (SELECT doc_id FROM deg)), 0) AS lost FROM pr) p
    LEFT JOIN (SELECT lk.target_id, sum(rank / degree) AS got FROM pr JOIN lk ON lk.doc_id = pr.doc_id JOIN deg ON deg.doc_id = pr.doc_id GROUP BY lk.target_id) g ON g.target_id = nd.doc_id WHERE p.step < 20)
SELECT doc_id, CAST(round(rank, 6) AS DOUBLE) AS rank FROM pr WHERE step = 20""")
def g06(spark, d):
    return r6(graph.pagerank(pages(spark, d).select("doc_id"), links(spark, d)), "rank")


@query("g07_orphans", f"WITH {RESOLVED} SELECT doc_id, source_path FROM documents WHERE doc_id NOT IN (SELECT target_id FROM resolved)")
def g07(spark, d):
    return graph.orphans(pages(spark, d), links(spark, d))


COOC = CHUNKS + f""",
tk AS (SELECT doc_id, chunk_index, {TOKENS.format('content')} AS ts FROM chunks),
pos AS (SELECT doc_id, chunk_index, len(ts) AS n, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tk),
pr AS (SELECT a.t AS a, b.t AS b, 0.2 AS w FROM pos a JOIN (SELECT doc_id, chunk_index, t, unnest([i - 2, i - 1, i + 1, i + 2]) AS i FROM pos) b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index AND b.i = a.i
    WHERE a.n >= 5 AND a.i BETWEEN 3 AND a.n - 2 AND a.t <> b.t
    UNION ALL SELECT a.t, b.t, 1.0 / a.n FROM pos a JOIN pos b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index AND b.i > a.i WHERE a.n < 5),
cooc AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM pr UNION ALL SELECT b, a, w FROM pr WHERE a <> b) GROUP BY a, b)"""


@query("m01_cooccurrence", f"WITH {COOC} SELECT a, b, CAST(round(w, 6) AS DOUBLE) AS w FROM cooc")
def m01(spark, d):
    return r6(vectors.cooccurrence(chunks(spark, d)), "w")


@query("m05_components", f"WITH {COOC} SELECT count(*) AS cells, CASE WHEN count(*) > 1000000 THEN 12 WHEN count(*) > 250000 THEN 16 WHEN count(*) > 50000 THEN 24 ELSE 32 END AS components FROM cooc")
def m05(spark, d):
    n = vectors.cooccurrence(chunks(spark, d)).agg(F.count("*").alias("cells"))
    return n.select("cells", F.when(F.col("cells") > 1_000_000, 12).when(F.col("cells") > 250_000, 16).when(F.col("cells") > 50_000, 24).otherwise(32).alias("components"))


@query("m07_eigenpairs")
def m07(spark, d):
    return r6(vectors.eigenpairs(vectors.cooccurrence(chunks(spark, d))).select("component", "eigenvalue").distinct(), "eigenvalue")


def embeddings(spark, d):
    return table(spark, d, "embeddings")


@query("m12_quantise", """SELECT vec_id, array_to_string([CAST(CASE WHEN x * 32767 >= 0 THEN floor(x * 32767 + 0.5) ELSE ceil(x * 32767 - 0.5) END AS INT) FOR x IN [least(greatest(CAST(e AS DOUBLE), -1.0), 1.0) FOR e IN embedding]], ',') AS q FROM embeddings""")
def m12(spark, d):
    return embeddings(spark, d).select("vec_id", F.array_join(vectors.quantised(F.col("embedding")).cast("array<string>"), ",").alias("q"))


@query("m13_mean_vectors", "SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def m13(spark, d):
    return r6(vectors.mean_vectors(embeddings(spark, d), "label", "embedding").withColumnRenamed("at", "pos"), "value")


_DOT = "list_sum([CAST({0}[k] AS DOUBLE) * CAST({1}[k] AS DOUBLE) FOR k IN range(1, len({0}) + 1)])"


@query("m14_cosine", f"""SELECT a.vec_id, round({_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')}), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m14(spark, d):
    e = embeddings(spark, d)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("m22_frobenius_drift", f"""WITH {COOC}, one AS (SELECT a, b, sum(w) AS w FROM cooc GROUP BY a, b) SELECT round(sqrt(sum(power(w - 0.9 * w, 2))), 6) AS drift FROM one""")
def m22(spark, d):
    c = vectors.cooccurrence(chunks(spark, d))
    return c.join(c.select("a", "b", (0.9 * F.col("w")).alias("v")), ["a", "b"], "full").agg(F.round(F.sqrt(F.sum(F.pow(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)), 2))), 6).alias("drift"))


@query("x06_signature", """WITH long AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos) AS k FROM long QUALIFY k <= 16), s AS (SELECT *, max(abs(CAST(x AS DOUBLE))) OVER (PARTITION BY vec_id) AS scale FROM k)
SELECT vec_id, CAST(pos AS INT) AS pos, CAST(CASE WHEN x >= 0 THEN floor(CAST(x AS DOUBLE) / scale * 127 + 0.5) ELSE ceil(CAST(x AS DOUBLE) / scale * 127 - 0.5) END AS INT) AS q, round(scale, 6) AS scale FROM s""")
def x06(spark, d):
    return r6(vectors.compressed(embeddings(spark, d), "vec_id", "embedding", 16).withColumnRenamed("at", "pos"), "scale")
