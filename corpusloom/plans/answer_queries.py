"""Queries of classes, answers, baseline and metrics, sessions as chains, hubs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, hierarchy
from corpusloom.plans.registry import query
from corpusloom.plans.ranking_queries import _PROF, RANKED, _in, _list, class_bias_sql
from corpusloom.plans.retrieval_queries import index, index_for, r6
from corpusloom.plans.text_queries import _EXACT, TOKENS, asked, dates_sql, docs
from corpusloom.session import cut, table

def _profiled(spark, d):
    p = F.concat_ws(" ", "source_path", "title")
    return docs(spark, d).select("doc_id", F.lower(p).alias("profile"), F.coalesce(T.date_parts(p)["year"].isNotNull(), F.lit(False)).alias("dated"))


@query("q17_profile_features", f"""WITH {_PROF} SELECT doc_id, CAST(round(least(CASE WHEN dated THEN 0.7 ELSE 0 END + CASE WHEN {_in('profile', answers.EPISODIC)} THEN 0.3 ELSE 0 END, 1.0), 6) AS DOUBLE) AS episodic,
CAST(CASE WHEN {_in('profile', answers.AGGREGATE)} THEN 1 ELSE 0 END AS DOUBLE) AS aggregate, CAST(CASE WHEN dated AND NOT {_in('profile', answers.AGGREGATE)} THEN 1 ELSE 0 END AS DOUBLE) AS session_note,
CAST(CASE WHEN {_in('profile', answers.CLASSES['guide'])} THEN 1 ELSE 0 END AS DOUBLE) AS evergreen FROM pf""")
def q17(spark, d):
    p = _profiled(spark, d)
    return p.select("doc_id", *[F.round(v, 6).alias(k) for k, v in answers.profile_features(F.col("profile"), F.col("dated")).items()])


@query("q18_memory_class", f"WITH {_PROF} SELECT doc_id, CASE " + " ".join(f"WHEN {_in('profile', w)} THEN '{c}'" for c, w in answers.CLASSES.items()) + " WHEN dated THEN 'daily_note' ELSE 'other' END AS class FROM pf")
def q18(spark, d):
    return _profiled(spark, d).select("doc_id", answers.memory_class(F.col("profile"), F.col("dated")).alias("class"))


_ALL = ["daily_note", "review", "research", "summary", "guide", "project_note", "other"]


@query("q19_class_bias", f"""WITH q AS (SELECT doc_id, {_EXACT.format('title')} AS terms, {_in("lower(strip_accents(title))", T.RECALL)} OR doc_id % 2 = 0 AS recall FROM documents WHERE title IS NOT NULL), x AS (SELECT *, unnest({_list(_ALL)}) AS class FROM q)
SELECT doc_id, class, CAST({class_bias_sql("terms", "recall", "class")} AS DOUBLE) AS bias FROM x""")
def q19(spark, d):
    q = docs(spark, d).filter("title is not null").select("doc_id", T.exact_terms(F.col("title")).alias("terms"), (T.recall_intent(F.col("title")) | (F.col("doc_id") % 2 == 0)).alias("recall"), F.explode(F.array(*[F.lit(c) for c in _ALL])).alias("class"))
    return q.select("doc_id", "class", answers.class_bias(F.col("terms"), F.col("recall"), F.col("class")).alias("bias"))


BASE = f"""dt AS (SELECT doc_id, source_path, {TOKENS.format("coalesce(title, '')")} AS title, {TOKENS.format('source_path')} AS path, {TOKENS.format('text')} AS body FROM documents WHERE trim(text) <> ''),
av AS (SELECT count(*) AS n, avg(len(title)) AS t, avg(len(path)) AS p, avg(len(body)) AS b FROM dt),
fl AS (SELECT doc_id, source_path, 3.0 AS w, 0.25 + 0.75 * len(title) / greatest((SELECT t FROM av), 1) AS norm, unnest(title) AS token FROM dt UNION ALL SELECT doc_id, source_path, 1.5, 0.25 + 0.75 * len(path) / greatest((SELECT p FROM av), 1), unnest(path) FROM dt
    UNION ALL SELECT doc_id, source_path, 1.0, 0.25 + 0.75 * len(body) / greatest((SELECT b FROM av), 1), unnest(body) FROM dt),
bq AS (SELECT query_id, list_distinct([t FOR t IN {TOKENS.format('query_text')} IF strlen(t) >= 2 AND NOT list_contains({_list(T.STOP)}, t)]) AS terms FROM asked),
bt AS (SELECT query_id, unnest(terms) AS token FROM bq),
wf AS (SELECT token, doc_id, source_path, sum(w / norm) AS wf FROM fl WHERE token IN (SELECT token FROM bt) GROUP BY ALL),
bd AS (SELECT token, count(*) AS df FROM wf GROUP BY token),
bs AS (SELECT query_id, doc_id, source_path, sum(ln(1 + ((SELECT n FROM av) - df + 0.5) / (df + 0.5)) * wf * 2.2 / (1.2 + wf)) AS s FROM wf JOIN bd ON bd.token = wf.token JOIN bt ON bt.token = wf.token GROUP BY ALL),
bb AS (SELECT bs.query_id, bs.doc_id, bs.source_path, s + CASE WHEN len([t FOR t IN terms IF NOT list_contains(title, t)]) = 0 THEN 1.5 ELSE 0 END AS score FROM bs JOIN dt ON dt.doc_id = bs.doc_id JOIN bq ON bq.query_id = bs.query_id),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source_path, doc_id) AS rank FROM bb QUALIFY rank <= 10)"""


@query("q28_fielded_baseline", f"WITH asked AS (SELECT DISTINCT query_id, query_text FROM lexical_candidate), {BASE} SELECT query_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM br")
def q28(spark, d):
    return r6(answers.fielded_baseline(docs(spark, d), asked(spark, d)), "score")


CASES = """lone AS (SELECT title, min(doc_id) AS doc_id FROM documents WHERE title IS NOT NULL AND trim(text) <> '' GROUP BY title HAVING count(*) = 1),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM lone),
cases AS (SELECT q AS query_id, title AS query_text, doc_id FROM num JOIN (SELECT unnest(range(0, 40)) AS q) x ON pos = floor(q * (n - 1) / 39))"""


def _cases(spark, d):
    return answers.sampled_cases(docs(spark, d), 40)


@query("q30_sampled_cases", f"WITH {CASES} SELECT query_id, query_text, doc_id FROM cases")
def q30(spark, d):
    return _cases(spark, d)


@query("q29_baseline_metrics", f"""WITH {CASES}, asked AS (SELECT query_id, query_text FROM cases), {BASE}
SELECT count(*) AS cases, count(rank) AS hits, CAST(round(count(rank) / count(*), 6) AS DOUBLE) AS hit_rate, CAST(round(avg(coalesce(1.0 / rank, 0)), 6) AS DOUBLE) AS mrr FROM cases c LEFT JOIN (SELECT * FROM br WHERE rank <= 5) b ON b.query_id = c.query_id AND b.doc_id = c.doc_id""")
def q29(spark, d):
    c = _cases(spark, d)
    return r6(answers.retrieval_metrics(c, answers.fielded_baseline(docs(spark, d), c.select("query_id", "query_text"))), "hit_rate", "mrr")


@query("q29_engine_metrics")
def q29_engine(spark, d):
    c = _cases(spark, d)
    return r6(answers.retrieval_metrics(c, index(spark, d).ranked_documents(c.select("query_id", "query_text"))), "hit_rate", "mrr")


@query("q29_nearest_rank", "SELECT q AS quantile, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events) JOIN (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q) x ON k = ceil((n - 1) * q)")
def q29_rank(spark, d):
    return answers.nearest_rank(table(spark, d, "events"), "value", [0.5, 0.95, 0.99])


_WS = "[t FOR t IN regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+') IF strlen(t) >= 4 AND t NOT IN (" + ", ".join(f"'{x}'" for x in T.GENERATOR_STOP) + ")]"
EVIDENCE = RANKED + f""",
ev AS (SELECT f.query_id, f.source_path, round(f.score, 6) AS score, d.text, q.query_text, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score, 9) DESC, f.source_path) AS rank FROM final f JOIN documents d ON d.doc_id = f.doc_id
    JOIN qs q ON q.query_id = f.query_id QUALIFY rank <= 5)"""


def evidence(spark, d):
    """The first five documents of each query, whole texts joined on after the ranking."""
    q = cut(asked(spark, d), "queries")
    best = cut(index_for(spark, d, q).ranked_documents(q, 5).select("query_id", "doc_id", "source_path", F.round("score", 6).alias("score"), "rank"), "ranked")
    return best.join(docs(spark, d).select("doc_id", "text"), "doc_id").join(q, "query_id")


@query("n01_concepts", f"""WITH {EVIDENCE}, t AS (SELECT query_id, source_path, score, unnest(list_distinct({_WS.format('text')})) AS term, {_WS.format('query_text')} AS asked_terms FROM ev),
s AS (SELECT query_id, term, sum(score) + 0.15 * count(DISTINCT source_path) AS score FROM t WHERE NOT list_contains(asked_terms, term) GROUP BY query_id, term),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS rank FROM s QUALIFY rank <= 10) SELECT query_id, term, CAST(round(score, 6) AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM k""")
def n01(spark, d):
    return r6(answers.concepts(evidence(spark, d)), "score")


@query("n04_answer_sentences")
def n04(spark, d):
    return answers.selected_sentences(evidence(spark, d))


@query("n06_simple_answer", f"WITH {EVIDENCE} SELECT query_id, md5(string_agg(text, ' ' ORDER BY rank)) AS digest FROM ev WHERE rank <= 3 GROUP BY query_id")
def n06(spark, d):
    return answers.simple_answers(evidence(spark, d)).select("query_id", F.md5("answer").alias("digest"))


@query("s20_conversation_chain", """WITH RECURSIVE one AS (SELECT conversation_id, node_id, max(parent) AS parent, max(current_node) AS cur FROM chatgpt_node WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
c AS (SELECT conversation_id, max(cur) AS cur FROM one GROUP BY ALL), walk AS (SELECT o.conversation_id, o.node_id, o.parent FROM one o JOIN c ON c.conversation_id = o.conversation_id AND c.cur = o.node_id
    UNION SELECT o.conversation_id, o.node_id, o.parent FROM walk w JOIN one o ON o.conversation_id = w.conversation_id AND o.node_id = w.parent)
SELECT conversation_id, node_id FROM walk WHERE conversation_id IN (SELECT conversation_id FROM walk w WHERE w.parent IS NULL OR NOT EXISTS (SELECT 1 FROM one x WHERE x.conversation_id = w.conversation_id AND x.node_id = w.parent))""")
def s20(spark, d):
    tree = hierarchy.hierarchy(table(spark, d, "chatgpt_node"), "node_id", "parent", ["conversation_id"], "exported_at", "current_node")
    return tree.filter("on_current_branch").select("conversation_id", "node_id")


@query("a10_folder_hubs", """WITH p AS (SELECT doc_id, string_split(source_path, '/') AS x FROM documents WHERE source_path IS NOT NULL), f AS (SELECT doc_id, array_to_string(x[:k], '/') AS folder FROM (SELECT *, unnest(range(1, len(x))) AS k FROM p))
SELECT folder, count(*) AS documents FROM f GROUP BY folder HAVING count(*) >= 2""")
def a10(spark, d):
    x = F.split("source_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda k: F.array_join(F.slice(x, 1, k), "/"))
    f = docs(spark, d).filter(F.size(x) > 1).select("doc_id", F.explode(up).alias("folder"))
    return f.groupBy("folder").agg(F.count("*").alias("documents")).filter("documents >= 2")


@query("a14_improving", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), a AS (SELECT user_id, avg(value) FILTER (k <= 5) AS recent, avg(value) FILTER (k BETWEEN 6 AND 10) AS before FROM r GROUP BY user_id)
SELECT user_id, round(recent, 6) AS recent, round(before, 6) AS before, coalesce(recent > before, FALSE) AS improving FROM a""")
def a14(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    a = table(spark, d, "events").withColumn("k", k).groupBy("user_id").agg(F.avg(F.when(F.col("k") <= 5, F.col("value"))).alias("recent"), F.avg(F.when(F.col("k").between(6, 10), F.col("value"))).alias("before"))
    return r6(a.withColumn("improving", F.coalesce(F.col("recent") > F.col("before"), F.lit(False))), "recent", "before")


@query("s16_page_edges", r"""WITH pg AS (SELECT result_id, unnest(string_split(markdown, chr(12))) AS page FROM (SELECT DISTINCT result_id, markdown FROM conversion_result WHERE contains(markdown, chr(12)))),
e AS (SELECT result_id, page, trim(regexp_extract(trim(page, chr(10) || ' '), '^([^\n]*)', 1)) AS first, trim(regexp_extract(trim(page, chr(10) || ' '), '([^\n]*)$', 1)) AS last FROM pg WHERE trim(page, chr(10) || ' ') <> ''),
n AS (SELECT result_id, count(*) AS pages FROM e GROUP BY result_id), l AS (SELECT result_id, first AS line FROM e UNION ALL SELECT result_id, last FROM e)
SELECT l.result_id, line, count(*) AS n FROM l JOIN n ON n.result_id = l.result_id WHERE pages >= 2 AND line <> '' GROUP BY l.result_id, line, pages HAVING count(*) >= 2 AND count(*) >= ceil(0.6 * pages)""")
def s16(spark, d):
    c = table(spark, d, "conversion_result").filter(F.contains("markdown", F.lit("\f"))).select("result_id", "markdown").distinct()
    p = c.select("result_id", F.explode(F.split("markdown", "\f")).alias("page")).withColumn("page", F.btrim("page", F.lit("\n "))).filter("page <> ''")
    e = p.select("result_id", F.trim(F.regexp_extract("page", r"\A([^\n]*)", 1)).alias("first"), F.trim(F.regexp_extract("page", r"([^\n]*)\z", 1)).alias("last"))
    n = e.groupBy("result_id").agg(F.count("*").alias("pages"))
    line = e.select("result_id", F.explode(F.array("first", "last")).alias("line")).filter("line <> ''").groupBy("result_id", "line").agg(F.count("*").alias("n"))
    return line.join(n, "result_id").filter((F.col("pages") >= 2) & (F.col("n") >= 2) & (F.col("n") >= F.ceil(0.6 * F.col("pages")))).select("result_id", "line", "n")
