"""Queries of single features and of what the others build on, one key a row of the inventory."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, chunking, graph, hierarchy, interactions, retrieval, sync, vectors
from corpusloom.plans.answer_queries import _PROF, EVIDENCE, evidence
from corpusloom.plans.graph_queries import COOC
from corpusloom.plans.learning_queries import PAIRS, _pairs
from corpusloom.plans.registry import SQL, query
from corpusloom.plans.ranking_queries import RANKED
from corpusloom.plans.retrieval_queries import CHUNKS, FEATURES, RANK, _featured, chunks, index, index_for, r6
from corpusloom.plans.text_queries import TOKENS, asked, dates_sql, docs
from corpusloom.session import cut, table


def _one(name, column, alias, where="TRUE"):
    @query(name, f"WITH {FEATURES} SELECT query_id, chunk_id, CAST(round({column}, 6) AS DOUBLE) AS {alias} FROM scored WHERE (score > 0 OR overlap > 0) AND {where}")
    def f(spark, d):
        return r6(_featured(spark, d).select("query_id", "chunk_id", alias), alias)
    return f


for _n, _c, _a in (("q10_metadata_overlap", "overlap", "metadata_overlap"), ("q11_compactness", "compactness", "compactness"), ("q12_exact_bonus", "exact_bonus", "exact_bonus"), ("q13_exactness", "exactness", "exactness"), ("q14_entity", "entity", "entity")):
    _one(_n, _c, _a)


@query("q06_lexical_score", f"WITH {RANK} SELECT query_id, chunk_id, CAST(round(lexical, 6) AS DOUBLE) AS lexical FROM sc")
def q06(spark, d):
    qs = cut(asked(spark, d), "queries")
    return r6(index_for(spark, d, qs).scored(qs, only=("chunk_id", "lexical")), "lexical")


_BOOST = f"""{PAIRS}, bo AS (SELECT query_id, token, max(relevance) AS boost FROM (SELECT query_id, unnest([a, b]) AS token, relevance FROM rp) x
WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.query_id = x.query_id AND sc.token = x.token) GROUP BY query_id, token), b32 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(boost, 9) DESC, token) AS k FROM bo QUALIFY k <= 32)"""


@query("q05_semantic_fill", f"""WITH {_BOOST}, po AS (SELECT DISTINCT doc_id * 16777216 + chunk_index AS chunk_id, unnest({TOKENS.format('content')}) AS token FROM chunks)
SELECT query_id, chunk_id, CAST(round(max(boost), 6) AS DOUBLE) AS semantic FROM b32 JOIN po ON po.token = b32.token GROUP BY query_id, chunk_id""")
def q05(spark, d):
    from pyspark.sql import Window

    from corpusloom.plans.learning_queries import _scores
    boosts = vectors.token_boosts(_pairs(spark, d), _scores(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(-F.round("boost", 9), "token"))).filter("k <= 32")
    return r6(retrieval.semantic_scores(chunks(spark, d), boosts.select("query_id", "token", "boost")), "semantic")


_ORD = "CAST(year AS BIGINT) * 372 + month * 31 + day"
_PATHTITLE = "(SELECT doc_id, concat_ws(' ', source_path, title) AS profile FROM documents)"


@query("a07_latest_ordinal", f"WITH {_PROF} SELECT max({_ORD}) AS latest FROM dated WHERE year IS NOT NULL")
def a07(spark, d):
    return docs(spark, d).agg(F.max(T.date_ordinal(T.date_parts(F.concat_ws(" ", "source_path", "title")))).alias("latest"))


@query("q15_freshness", f"""WITH {RANK}, {dates_sql(_PATHTITLE, 'doc_id', 'profile')}, o AS (SELECT k AS doc_id, {_ORD} AS ordinal, max({_ORD}) OVER () AS latest FROM dated WHERE year IS NOT NULL)
SELECT query_id, s.doc_id, CAST(round(CASE WHEN lexical_doc >= 0.45 OR doc_coverage >= 0.5 THEN coalesce(1 / (1 + (latest - ordinal) / 7.0) * 0.04, 0) ELSE 0 END, 6) AS DOUBLE) AS freshness FROM docsc s LEFT JOIN o ON o.doc_id = s.doc_id""")
def q15(spark, d):
    own = docs(spark, d).select("doc_id", T.date_ordinal(T.date_parts(F.concat_ws(" ", "source_path", "title"))).alias("ordinal"))
    latest = own.agg(F.max("ordinal")).first()[0]
    qs = cut(asked(spark, d), "queries")
    s = index_for(spark, d, qs).document_scores(qs).join(own, "doc_id", "left")
    return s.select("query_id", "doc_id", F.round(answers.freshness(F.lit("concept"), F.col("lexical_doc"), F.col("doc_coverage"), F.col("ordinal"), F.lit(latest)), 6).alias("freshness"))


@query("q16_temporal_match", f"""WITH {dates_sql(_PATHTITLE, 'doc_id', 'profile')} SELECT a.k AS doc_id, CAST(CASE WHEN b.month = a.month AND b.day = a.day AND a.year IS NOT NULL THEN CASE WHEN b.year IS NULL THEN 0.8 WHEN b.year = a.year THEN 1 ELSE 0 END ELSE 0 END AS DOUBLE) AS temporal
FROM dated a JOIN dated b ON b.k = a.k + 1""")
def q16(spark, d):
    own = docs(spark, d).select("doc_id", T.date_parts(F.concat_ws(" ", "source_path", "title")).alias("p")).filter("p is not null")
    other = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q"))
    return own.join(other, "doc_id").select("doc_id", answers.temporal_match(F.col("q"), F.col("p")).alias("temporal"))


RULES = [{"class": "research", "content_contains": ["hipótese", "hypothesis"], "priority": 1}, {"class": "guide", "path_contains": ["codex/"], "priority": 3}, {"class": "review", "title_contains": ["Revisão", "review"], "priority": 3}]


@query("j09_rule_needles", """SELECT doc_id, CASE WHEN contains(lower(strip_accents(source_path)), 'codex/') THEN 'guide' WHEN contains(lower(strip_accents(title)), 'revisao') OR contains(lower(strip_accents(title)), 'review') THEN 'review'
WHEN contains(lower(strip_accents(text)), 'hipotese') OR contains(lower(strip_accents(text)), 'hypothesis') THEN 'research' END AS class FROM documents""")
def j09(spark, d):
    x = docs(spark, d).select("doc_id", T.fold(F.col("source_path")).alias("p"), T.fold(F.col("title")).alias("t"), T.fold(F.col("text")).alias("c"), T.frontmatter_tags(F.col("text")).alias("tags"))
    return x.select("doc_id", answers.rule_class(RULES, F.col("p"), F.col("t"), F.col("tags"), F.col("c")).alias("class"))


VOCAB = COOC + """, vb AS (SELECT t AS token, row_number() OVER (ORDER BY min({'d': doc_id, 'c': chunk_index, 'i': i})) - 1 AS token_id FROM pos GROUP BY t)"""


@query("d07_vocabulary", f"WITH {VOCAB} SELECT token, token_id FROM vb")
def d07(spark, d):
    return vectors.vocabulary(chunks(spark, d))


@query("m02_capped_cooccurrence", f"""WITH {VOCAB}, op AS (SELECT a.doc_id, a.chunk_index, a.i * 4 + o AS ord, a.t AS a, b.t AS b, 0.2 AS w FROM pos a JOIN (SELECT doc_id, chunk_index, t, unnest([i + 2, i + 1, i - 1, i - 2]) AS i, unnest([0, 1, 2, 3]) AS o FROM pos) b
    ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index AND b.i = a.i WHERE a.n >= 5 AND a.i BETWEEN 3 AND a.n - 2 AND a.t <> b.t
    UNION ALL SELECT a.doc_id, a.chunk_index, a.i * 10 + b.i, a.t, b.t, 1.0 / a.n FROM pos a JOIN pos b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index AND b.i > a.i WHERE a.n < 5),
bad AS (SELECT doc_id, chunk_index, min(ord) AS first FROM op WHERE a IN (SELECT token FROM vb WHERE token_id >= 1000) OR b IN (SELECT token FROM vb WHERE token_id >= 1000) GROUP BY ALL),
kp AS (SELECT op.a, op.b, op.w FROM op LEFT JOIN bad ON bad.doc_id = op.doc_id AND bad.chunk_index = op.chunk_index WHERE first IS NULL OR ord < first)
SELECT a, b, CAST(round(sum(w), 6) AS DOUBLE) AS w FROM (SELECT a, b, w FROM kp UNION ALL SELECT b, a, w FROM kp WHERE a <> b) GROUP BY a, b""")
def m02(spark, d):
    return r6(vectors.capped_cooccurrence(chunks(spark, d), 1_000), "w")


# As many tokens as the reference's matrix has; m02_capped_cooccurrence shows the cap on a small one.
@query("m02_whole_cooccurrence", SQL["m02_capped_cooccurrence"].replace("token_id >= 1000", "token_id >= 10000"))
def m02_whole(spark, d):
    return r6(vectors.capped_cooccurrence(chunks(spark, d)), "w")


@query("m04_triplets", f"WITH {COOC} SELECT count(*) AS cells, count(*) FILTER (a = b) AS diagonal, CAST(round(sum(w), 4) AS DOUBLE) AS mass FROM cooc")
def m04(spark, d):
    return vectors.cooccurrence(chunks(spark, d)).agg(F.count("*").alias("cells"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("diagonal"), F.round(F.sum("w"), 4).alias("mass"))


@query("m18_ranked_pairs", f"WITH {PAIRS} SELECT query_id, CAST(rank AS INT) AS rank, a, b FROM rp WHERE rank <= 10")
def m18(spark, d):
    return _pairs(spark, d).filter("rank <= 10").select("query_id", "rank", "a", "b")


@query("n02_evidence_order", f"WITH {EVIDENCE} SELECT query_id, source_path, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM ev")
def n02(spark, d):
    return evidence(spark, d).select("query_id", "source_path", "score", "rank")


@query("q21_document_rollup", f"""WITH {FEATURES}, ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY round(score, 9) DESC, rank) AS pos FROM scored WHERE score > 0 OR overlap > 0)
SELECT query_id, source_path, CAST(round(max(score) FILTER (pos = 1), 6) AS DOUBLE) AS best, CAST(round(coalesce(max(score) FILTER (pos = 2), 0), 6) AS DOUBLE) AS second, arg_min(chunk_id, pos) AS best_chunk FROM ordered GROUP BY query_id, source_path""")
def q21(spark, d):
    from pyspark.sql import Window
    f = _featured(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("query_id", "source_path").orderBy(-F.round("score", 9), "rank")))
    g = f.groupBy("query_id", "source_path").agg(F.max(F.when(F.col("at") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("at") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.min_by("chunk_id", "at").alias("best_chunk"))
    return r6(g, "best", "second")


@query("q23_confidence", "SELECT query_id, chunk_idx, round(0.45 * least(query_coverage, 1) + 0.35 * least(query_coverage, 1) + 0.15 + 0.05 * 0.5, 6) AS confidence FROM (SELECT DISTINCT query_id, chunk_idx, query_coverage FROM lexical_candidate WHERE query_coverage IS NOT NULL)")
def q23(spark, d):
    c = table(spark, d, "lexical_candidate").filter("query_coverage is not null").select("query_id", "chunk_idx", "query_coverage").distinct()
    x = F.col("query_coverage")
    return c.select("query_id", "chunk_idx", F.round(retrieval.confidence(x, F.lit(None).cast("double"), x, F.lit(0.5)), 6).alias("confidence"))


@query("t14_sentences")
def t14(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(answers.sentences(F.col("text"))).alias("place", "sentence"))


@query("t16_evidence_text", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s*---\n(?:.*\n)*?---[ \t]*(?:\n|$)', ''), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest
FROM documents WHERE text IS NOT NULL""")
def t16(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", F.md5(T.evidence_text(F.col("text"))).alias("digest"))


@query("s21_first_child_threads", """WITH RECURSIVE one AS (SELECT conversation_id AS c, node_id AS n, max(parent) AS p FROM chatgpt_node WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
kid AS (SELECT a.c, a.p, min(a.n) AS n FROM one a JOIN one b ON b.c = a.c AND b.n = a.p GROUP BY a.c, a.p),
t AS (SELECT c, n, 0 AS place FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.c = a.c AND b.n = a.p) UNION ALL SELECT t.c, kid.n, place + 1 FROM t JOIN kid ON kid.c = t.c AND kid.p = t.n)
SELECT c AS conversation_id, n AS node_id, CAST(place AS BIGINT) AS place FROM t""")
def s21(spark, d):
    return hierarchy.first_child_threads(table(spark, d, "chatgpt_node"), "node_id", "parent", ["conversation_id"], "exported_at")


@query("i04_replaced_source", "SELECT doc_id, source_path FROM documents WHERE NOT starts_with(source_path, 'folder/scans/') OR doc_id % 2 = 0 OR source_path IS NULL")
def i04(spark, d):
    all_ = docs(spark, d).select("doc_id", "source_path")
    inside = F.coalesce(sync.belongs(F.col("source_path"), F.lit("folder"), F.lit("folder/scans")), F.lit(False))
    return all_.filter(~inside).unionByName(all_.filter(inside & (F.col("doc_id") % 2 == 0)))


@query("i06_rebuilt_counts", f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(len({TOKENS.format('content')}) AS INT) AS token_count FROM chunks")
def i06(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", F.size(T.tokens(F.col("content"))).alias("token_count"))


@query("c04_windows")
def c04(spark, d):
    return chunking.chunks(docs(spark, d), 128, 16).select("doc_id", "chunk_index", "token_count")


@query("x03_merge_decision", "SELECT vec_id, CASE WHEN s >= 0.9 THEN 'merge' WHEN s >= 0.7 THEN 'review' ELSE 'separate' END AS decision FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 5 AS s FROM embeddings)")
def x03(spark, d):
    return table(spark, d, "embeddings").select("vec_id", interactions.merge_decision(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 5).alias("decision"))




_RANKED = RANKED + f""",
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source_path) AS dr FROM final QUALIFY dr <= 10),
bm AS (SELECT query_id, source_path, doc_id, dr, CASE WHEN dr = 1 THEN 6 WHEN dr <= 3 THEN 4 ELSE 2 END AS most FROM best),
pri AS (SELECT query_id, source_path, chunk_id % 16777216 AS own FROM ordered WHERE pos = 1),
rk AS (SELECT o.query_id, o.source_path, chunk_id, CASE WHEN pos = 1 THEN 0 ELSE 1 END AS phase, pos AS ord FROM ordered o JOIN pri p ON p.query_id = o.query_id AND p.source_path = o.source_path
    WHERE pos = 1 OR abs(chunk_id % 16777216 - own) <= 1 OR coverage >= 0.34 OR exactness >= 0.4 OR entity >= 0.5 OR overlap >= 0.6),
pos_in AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM idc),
own AS (SELECT *, least(most, n) AS size FROM bm JOIN pos_in USING (doc_id)),
smp AS (SELECT query_id, source_path, list_distinct([CASE WHEN size = 1 THEN 0 ELSE s * (n - 1) // (size - 1) END FOR s IN range(0, size)]) AS ps, chunk_id, pos FROM own),
un AS (SELECT * FROM rk UNION ALL SELECT query_id, source_path, chunk_id, CASE WHEN list_contains(ps, pos - 1) THEN 2 ELSE 3 END, pos FROM smp),
mn AS (SELECT u.query_id, u.source_path, u.chunk_id, min({{'phase': phase, 'ord': ord}}) AS p FROM un u JOIN bm ON bm.query_id = u.query_id AND bm.source_path = u.source_path GROUP BY ALL),
kp AS (SELECT mn.query_id, mn.source_path, mn.chunk_id, bm.dr, row_number() OVER (PARTITION BY mn.query_id, mn.source_path ORDER BY p, mn.chunk_id) AS k, most FROM mn JOIN bm ON bm.query_id = mn.query_id AND bm.source_path = mn.source_path QUALIFY k <= most)"""


@query("q24_evidence_bundles", f"WITH {_RANKED} SELECT query_id, source_path, CAST(dr AS INT) AS rank, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, source_path ORDER BY chunk_id % 16777216, chunk_id) AS INT) AS place FROM kp")
def q24(spark, d):
    return index(spark, d).bundles(asked(spark, d))


@query("a09_field_statistics", f"""SELECT count(*) AS documents, CAST(round(avg(len({TOKENS.format("coalesce(title, '')")})), 6) AS DOUBLE) AS title_length, CAST(round(avg(len({TOKENS.format('source_path')})), 6) AS DOUBLE) AS path_length,
CAST(round(avg(len({TOKENS.format('text')})), 6) AS DOUBLE) AS body_length FROM documents WHERE trim(text) <> ''""")
def a09(spark, d):
    n = lambda c: F.round(F.avg(F.size(T.tokens(c))), 6)
    return docs(spark, d).filter("trim(text) <> ''").agg(F.count("*").alias("documents"), n(F.coalesce("title", F.lit(""))).alias("title_length"), n(F.col("source_path")).alias("path_length"), n(F.col("text")).alias("body_length"))


@query("a11_hub_pages", """WITH f AS (SELECT regexp_replace(source_path, '/[^/]*$', '') AS folder, doc_id, source_path, coalesce(title, '') AS title FROM documents WHERE contains(source_path, '/'))
SELECT folder, md5('# ' || folder || chr(10) || chr(10) || string_agg('- [[' || regexp_replace(source_path, '\\.md$', '') || '|' || title || ']]', chr(10) ORDER BY lower(title), source_path, doc_id)) AS digest, count(*) AS documents FROM f GROUP BY folder HAVING count(*) <= 1000""")
def a11(spark, d):
    return graph.hub_pages(docs(spark, d), 1_000).select("folder", F.md5("page").alias("digest"), "documents")


@query("j01_chunk_documents", f"WITH {CHUNKS} SELECT c.doc_id, CAST(chunk_index AS INT) AS chunk_index, d.lang, d.created_at IS NULL AS undated FROM chunks c LEFT JOIN documents d ON d.doc_id = c.doc_id")
def j01(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index").join(docs(spark, d).select("doc_id", "lang", F.col("created_at").isNull().alias("undated")), "doc_id", "left")


@query("i09_intervals", "SELECT DISTINCT x AS job_interval, n * CASE right(x, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END AS seconds FROM (SELECT total_files || CASE total_files % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'h' ELSE 'd' END AS x, total_files AS n FROM operation_checkpoint WHERE total_files IS NOT NULL)")
def i09(spark, d):
    n = F.col("total_files")
    x = F.concat(n.cast("string"), F.when(n % 3 == 0, "m").when(n % 3 == 1, "h").otherwise("d"))
    return table(spark, d, "operation_checkpoint").filter("total_files is not null").select(x.alias("job_interval")).distinct().withColumn("seconds", sync.interval_seconds(F.col("job_interval")))
