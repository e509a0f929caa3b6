"""Queries of session readers, conversion, rendered results, reflection and rates."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, reflection, retrieval, spectral
from corpusloom.plans.answer_queries import EVIDENCE, evidence
from corpusloom.plans.ranking_queries import token_vectors
from corpusloom.plans.registry import query
from corpusloom.plans.detail_queries import _RANKED
from corpusloom.plans.retrieval_queries import index, index_for, r6
from corpusloom.plans.text_queries import asked, docs
from corpusloom.plans.upkeep_queries import TRAJECTORIES, trajectories
from corpusloom.session import cut, table
from corpusloom.sources import convert, sessions


def codex_json(spark, d):
    """The lines of the session table as JSON, as they stand in session files."""
    t = table(spark, d, "codex_session").select("session_id", "rollout_path", "line_no", "type", "timestamp", "payload").distinct().filter("line_no is not null")
    return t.select(F.col("rollout_path").alias("path"), "line_no", F.to_json(F.struct("type", "timestamp", "payload")).alias("line"))


def claude_json(spark, d):
    t = table(spark, d, "droid_session").select("session_id", "file_path", "line_no", "timestamp", "message").distinct().filter("line_no is not null and message is not null")
    line = F.to_json(F.struct(F.lower(F.trim("message.role")).alias("type"), F.col("file_path").alias("cwd"), "timestamp", F.struct(F.lower(F.trim("message.role")).alias("role"), "message.content").alias("message")))
    return t.select(F.concat(F.lit("/p/-home-me-work-"), "session_id", F.lit("/"), F.regexp_extract("file_path", "([^/]*)$", 1)).alias("path"), "line_no", line.alias("line"))


_CODEX = r"""l AS (SELECT DISTINCT rollout_path, line_no, type, timestamp, payload FROM codex_session WHERE line_no IS NOT NULL),
meta AS (SELECT rollout_path, arg_max(payload.id, line_no) FILTER (payload.id IS NOT NULL) AS id, arg_max(payload.cwd, line_no) FILTER (payload.cwd IS NOT NULL) AS cwd FROM l WHERE type = 'session_meta' GROUP BY rollout_path),
m AS (SELECT coalesce(id, regexp_replace(regexp_extract(l.rollout_path, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1')) AS session_id, cwd, l.rollout_path AS path, line_no, payload.role AS role,
    array_to_string([x.text FOR x IN payload.content IF x.type IN ('text', 'input_text', 'output_text') AND coalesce(trim(x.text, ' ') <> '', FALSE)], chr(10)) AS content
    FROM l LEFT JOIN meta ON meta.rollout_path = l.rollout_path WHERE type = 'response_item' AND payload.role IN ('user', 'assistant'))"""


@query("s08_codex_messages", f"WITH {_CODEX} SELECT session_id, cwd, path, line_no, role, md5(content) AS digest FROM m WHERE trim(content, ' ') <> ''")
def s08(spark, d):
    return sessions.codex_messages(codex_json(spark, d)).select("session_id", "cwd", "path", "line_no", "role", F.md5("content").alias("digest"))


_CLAUDE = r"""l AS (SELECT DISTINCT session_id, file_path, line_no, lower(trim(message.role)) AS role, message.content AS content FROM droid_session WHERE line_no IS NOT NULL AND message IS NOT NULL),
m AS (SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS session_id, session_id AS folder, line_no, role,
    array_to_string([x.text FOR x IN content IF coalesce(trim(x.text, ' ') <> '', FALSE)], chr(10)) AS content FROM l WHERE role IN ('user', 'assistant'))"""


@query("s06_claude_messages", f"WITH {_CLAUDE} SELECT session_id, line_no, role, md5(content) AS digest, count(*) AS n FROM m WHERE trim(content, ' ') <> '' GROUP BY ALL")
def s06(spark, d):
    m = sessions.claude_messages(claude_json(spark, d))
    return m.groupBy("session_id", "line_no", "role", F.md5("content").alias("digest")).agg(F.count("*").alias("n"))


@query("c05_claude_turns", f"""WITH {_CLAUDE}, p AS (SELECT *, 'work/' || replace(folder, '-', '/') AS project FROM m WHERE trim(content, ' ') <> '')
SELECT 'claude://' || project || '#' || session_id AS source_path, line_no, role || ' message' AS section_title, md5('[' || role || ' → ' || project || ']' || chr(10) || content) AS digest FROM p""")
def c05(spark, d):
    return sessions.claude_turns(sessions.claude_messages(claude_json(spark, d))).select("source_path", "line_no", "section_title", F.md5("content").alias("digest"))


@query("s22_session_markdown", f"""WITH {_CODEX}, o AS (SELECT session_id, path, line_no, role, trim(regexp_replace(content, '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), ' ') AS said FROM m WHERE trim(content, ' ') <> ''),
t AS (SELECT path AS session_id, substr(trim(regexp_replace(arg_min(said, line_no) FILTER (role = 'user'), '\\s+', ' ', 'g'), ' '), 1, 120) AS title, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || said, chr(10) || chr(10) ORDER BY line_no, role, said) AS body FROM o WHERE said <> '' GROUP BY path)
SELECT session_id, coalesce(title, session_id) AS title, md5('# ' || coalesce(title, session_id) || chr(10) || chr(10) || body || chr(10)) AS digest FROM t""")
def s22(spark, d):
    m = sessions.codex_messages(codex_json(spark, d)).withColumn("session_id", F.col("path"))
    return sessions.session_markdown(m).select("session_id", "title", F.md5("text").alias("digest"))


@query("s17_notebooks", """SELECT doc_id, md5(CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || '```python' || chr(10) || text || chr(10) || '```') AS digest FROM documents WHERE trim(text, ' ') <> ''""")
def s17(spark, d):
    cell = lambda kind, lines: F.struct(F.lit(kind).alias("cell_type"), lines.alias("source"))
    t = F.coalesce("title", F.lit(""))
    nb = F.to_json(F.struct(F.array(cell("markdown", F.when(F.trim(t) != "", F.array(F.lit("# "), t)).otherwise(F.array(F.lit(" ")))), cell("code", F.array("text"))).alias("cells")))
    return docs(spark, d).filter("trim(text) <> ''").select("doc_id", F.md5(convert.notebook_markdown(nb)).alias("digest"))


@query("s16_page_cleanup", """WITH p AS (SELECT conversation_id, list(node_id ORDER BY node_id) AS ns FROM (SELECT DISTINCT conversation_id, node_id FROM chatgpt_node WHERE conversation_id IS NOT NULL AND node_id IS NOT NULL) GROUP BY conversation_id)
SELECT conversation_id, md5(array_to_string([CASE WHEN len(ns) >= 3 THEN '' ELSE 'Title of all' || chr(10) END || 'body ' || x || ' is hyphenated here' || CASE WHEN len(ns) >= 3 THEN '' ELSE chr(10) || 'Foot' END FOR x IN ns], chr(10) || chr(10))) AS digest FROM p""")
def s16(spark, d):
    page = lambda x: F.concat(F.lit("Title of all\nbody "), x, F.lit(" is hyphen-\nated here\nFoot"))
    p = table(spark, d, "chatgpt_node").filter("conversation_id is not null and node_id is not null").groupBy("conversation_id").agg(F.array_sort(F.collect_set("node_id")).alias("ns"))
    return p.select("conversation_id", F.md5(convert.cleaned_pages(F.array_join(F.transform("ns", page), "\f"))).alias("digest"))


@query("q25_rendered_results", f"""WITH {_RANKED}, sh AS (SELECT kp.query_id, kp.source_path, kp.dr, i.content, i.chunk_index, kp.chunk_id FROM kp JOIN idc i ON i.chunk_id = kp.chunk_id),
j AS (SELECT query_id, source_path, dr, string_agg(content, chr(10) || chr(10) ORDER BY chunk_id % 16777216, chunk_id) AS text, arg_min(chunk_index, chunk_id % 16777216) AS first FROM sh GROUP BY ALL)
SELECT j.query_id, j.source_path, CAST(j.dr AS INT) AS rank, CAST(round(least(greatest(b.score, 0), 1), 6) AS DOUBLE) AS score, CAST(first AS INT) AS chunk_index,
md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s*---\\n(?:.*\\n)*?---[ \\t]*(?:\\n|$)', ''), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM j JOIN best b ON b.query_id = j.query_id AND b.source_path = j.source_path""")
def q25(spark, d):
    qs = cut(asked(spark, d), "queries")
    ix = index_for(spark, d, qs)
    found = cut(ix.candidates(qs), "candidates")
    ranked = cut(ix.ranked_documents(qs, found=found), "ranked")
    shown = ix.bundles(qs, ranked=ranked, found=found)
    r = answers.rendered_results(shown, ix.chunks.select(retrieval.chunk_id(), "content", "chunk_index"), ranked)
    return r6(r.select("query_id", "source_path", "rank", "score", "chunk_index", F.md5("content").alias("digest")), "score")


@query("n05_answer_texts")
def n05(spark, d):
    qs = cut(asked(spark, d), "queries")
    ranked = cut(index_for(spark, d, qs).ranked_documents(qs, 5), "ranked")
    e = cut(ranked.select("query_id", "doc_id", "source_path", "score", "rank").join(docs(spark, d).select("doc_id", "text"), "doc_id").join(qs, "query_id"), "evidence")
    return r6(answers.answer_texts(qs, ranked, answers.selected_sentences(e), answers.concepts(e), e), "confidence")


@query("m20_matrix_confidence")
def m20(spark, d):
    m = token_vectors(spark, d, index(spark, d))
    return spark.createDataFrame([(m.cells, float(spectral.coherence(m.values)), m.confidence)], "cells bigint, coherence double, confidence double")


_PRAISED = "n_clicks >= 2 AS praised, avg_dwell AS longest_dwell"


def _judged(spark, d):
    return trajectories(spark, d).withColumns({"praised": F.col("n_clicks") >= 2, "longest_dwell": F.col("avg_dwell")})


@query("f10_patterns", f"WITH {TRAJECTORIES} SELECT query_id, coalesce(avg_dwell >= 30, FALSE) OR n_clicks >= 2 AS succeeded, status = 'abandoned' AND n_clicks = 0 AS failed FROM tr")
def f10(spark, d):
    return reflection.patterns(_judged(spark, d))


@query("f10_term_pairs", f"""WITH {TRAJECTORIES}, w AS (SELECT query_id, n_clicks, avg_dwell, [x FOR x IN string_split(lower(trim(query_text)), ' ') IF x <> ''] AS ws FROM tr),
t AS (SELECT query_id, n_clicks, avg_dwell, unnest(ws) AS term, generate_subscripts(ws, 1) AS i FROM w)
SELECT a.query_id, a.term AS term1, b.term AS term2, CAST(CASE WHEN a.n_clicks >= 2 THEN 0.9 WHEN a.avg_dwell > 30 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM t a JOIN t b ON b.query_id = a.query_id AND b.i > a.i""")
def f10_pairs(spark, d):
    return reflection.term_pairs(_judged(spark, d))


@query("f11_adapted", """WITH e AS (SELECT vec_id, unnest(embedding[1:6]) AS x, generate_subscripts(embedding[1:6], 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, CAST(round(sum(0.01 * CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)), 6) AS DOUBLE) AS w FROM e a JOIN e b ON b.vec_id = a.vec_id GROUP BY a.i, b.i""")
def f11(spark, d):
    return r6(reflection.adapted(table(spark, d, "embeddings").select(F.slice("embedding", 1, 6).alias("v")), "v", 0.01), "w")


@query("f12_world_model", """WITH o AS (SELECT DISTINCT query_text, chunk_idx % 40 AS result, lexical_score * 10 AS dwell, scored_at, chunk_idx FROM lexical_candidate WHERE query_text IS NOT NULL AND lexical_score IS NOT NULL),
c AS (SELECT array_to_string([x FOR x IN string_split(lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))), ' ') IF x <> ''], ' ') AS signature, result, list(least(greatest((dwell / 30) / (1 + dwell / 30), 0), 1) ORDER BY scored_at, dwell) AS cs FROM o GROUP BY ALL)
SELECT signature, result, CAST(round(list_reduce(cs, lambda a, b: (a + b) / 2), 6) AS DOUBLE) AS confidence, len(cs) AS observations FROM c""")
def f12(spark, d):
    o = table(spark, d, "lexical_candidate").filter("query_text is not null and lexical_score is not null").select("query_text", (F.col("chunk_idx") % 40).alias("result"), (F.col("lexical_score") * 10).alias("dwell"), F.col("scored_at").alias("at"), "chunk_idx").distinct()
    return r6(reflection.world_model(o), "confidence")


@query("f16_learning_rate", "SELECT DISTINCT query_id, chunk_idx, query_coverage, graph_score IS NULL AS shifted, CAST(round(least(greatest(0.1 * (1 + (query_coverage - 0.5) * 0.5) * CASE WHEN graph_score IS NULL THEN 2 ELSE 1 END, 0.001), 1), 6) AS DOUBLE) AS rate FROM lexical_candidate WHERE query_coverage IS NOT NULL")
def f16(spark, d):
    c = table(spark, d, "lexical_candidate").filter("query_coverage is not null").select("query_id", "chunk_idx", "query_coverage", F.col("graph_score").isNull().alias("shifted")).distinct()
    return c.withColumn("rate", F.round(reflection.learning_rate(F.col("query_coverage"), F.col("shifted")), 6))


@query("g08_project_links", "SELECT doc_id, CASE WHEN contains(lower(title), 'garden') THEN 'hubs/outside' WHEN contains(lower(title), 'plan') THEN 'hubs/plans' ELSE 'projects/' || title END AS link FROM documents WHERE title <> '' AND title <> 'unknown'")
def g08(spark, d):
    link = answers.project_link(F.col("title"), {"garden": "hubs/outside", "plan": "hubs/plans"}, "projects")
    return docs(spark, d).select("doc_id", link.alias("link")).filter("link is not null")
