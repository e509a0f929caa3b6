"""The queries of the llm operators, and the SQL that says the same where SQL can."""

from corpusloom.llm import conversations, distinctive, markup, packing, rank_fusion, scans, splitting, tokenizer
from corpusloom.session import table

Q = {}
SQL = {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put


SCORES = {"lexical_score": 1.0, "semantic_score": 1.0, "graph_score": 1.0, "query_coverage": 1.0}


def _fused(spark, d):
    return rank_fusion.fused_scores(table(spark, d, "lexical_candidate"), "query_id", "chunk_idx", SCORES, "scored_at")


_P3 = f"""WITH one AS (SELECT query_id, chunk_idx, max({{'v': scored_at, 'a': lexical_score, 'b': semantic_score, 'c': graph_score, 'd': query_coverage}}) AS m
    FROM lexical_candidate WHERE query_id IS NOT NULL AND chunk_idx IS NOT NULL GROUP BY query_id, chunk_idx),
long AS (SELECT query_id, chunk_idx, 0 AS k, m.a AS s FROM one UNION ALL SELECT query_id, chunk_idx, 1, m.b FROM one
    UNION ALL SELECT query_id, chunk_idx, 2, m.c FROM one UNION ALL SELECT query_id, chunk_idx, 3, m.d FROM one),
pct AS (SELECT *, (rank() OVER (PARTITION BY query_id, k ORDER BY s) + (count(*) OVER (PARTITION BY query_id, k, s) - 1) / 2.0 - 0.5)
    / count(*) OVER (PARTITION BY query_id, k) AS p FROM long WHERE s IS NOT NULL),
z AS (SELECT query_id, chunk_idx, {rank_fusion.inverse_normal_sql("p")} AS z FROM pct),
fused AS (SELECT o.query_id, o.chunk_idx, coalesce(sum(z.z), 0) / 4 AS fused FROM one o LEFT JOIN z ON z.query_id = o.query_id AND z.chunk_idx = o.chunk_idx
    GROUP BY o.query_id, o.chunk_idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, chunk_idx) AS rank FROM fused)"""


@query("p3_found", _P3 + "\nSELECT query_id, chunk_idx FROM ranked WHERE rank = 1")
def p3_found(spark, d):
    return rank_fusion.first_of_ranking(_fused(spark, d), "query_id", "chunk_idx")


@query("p3_ranking", _P3 + "\nSELECT query_id, chunk_idx, round(fused, 6) AS fused, rank FROM ranked")
def p3_ranking(spark, d):
    from pyspark.sql import functions as F
    return rank_fusion.ranking(_fused(spark, d), "query_id", "chunk_idx").withColumn("fused", F.round("fused", 6))


_P7 = """WITH post AS (SELECT chunk_idx, lower(term) AS term, sum(term_frequency) AS tf
    FROM (SELECT DISTINCT chunk_idx, term, term_frequency FROM posting WHERE chunk_idx IS NOT NULL AND term <> '' AND term_frequency > 0) GROUP BY chunk_idx, lower(term)),
n AS (SELECT CAST(count(DISTINCT chunk_idx) AS DOUBLE) AS n FROM post),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term),
scored AS (SELECT chunk_idx, post.term, CAST(tf AS BIGINT) AS tf, df, CAST(cf AS BIGINT) AS cf, tf * (-log2(df / n) + log2(1 - exp(-cf / n))) AS score
    FROM post JOIN stats ON stats.term = post.term CROSS JOIN n)"""


@query("p7_found", _P7 + """
SELECT chunk_idx, term FROM (SELECT *, row_number() OVER (PARTITION BY chunk_idx ORDER BY round(score, 9) DESC, term) AS k FROM scored) WHERE k = 1""")
def p7_found(spark, d):
    return distinctive.most_distinctive(distinctive.distinctiveness(table(spark, d, "posting"), "chunk_idx", "term", "term_frequency"), "chunk_idx", "term")


@query("p7_scores", _P7 + "\nSELECT chunk_idx, term, tf, df, cf, round(score, 6) AS score FROM scored")
def p7_scores(spark, d):
    from pyspark.sql import functions as F
    return distinctive.distinctiveness(table(spark, d, "posting"), "chunk_idx", "term", "term_frequency").withColumn("score", F.round("score", 6))


VOCABULARY = tokenizer.VOCABULARY
CAPACITY, LIMIT, OVERLAP = 4_096, 2_048, 128


@query("p8_ids")
def p8_ids(spark, d):
    return tokenizer.encoded(table(spark, d, "documents"), "doc_id", "text")


@query("p9_pack")
def p9_pack(spark, d):
    return packing.packed(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


@query("p9_blocks")
def p9_blocks(spark, d):
    """Small containers, blocks of few items: here best fit decreasing often misses the bound, and completion does better or proves it right."""
    return packing.block_report(table(spark, d, "documents"), "doc_id", "text", 768, block=48)


@query("p10_found")
def p10_found(spark, d):
    cut = splitting.split_texts(table(spark, d, "documents"), "doc_id", "text", LIMIT, OVERLAP, with_text=False)
    return cut.filter("piece = 1").select("doc_id")


@query("p10_pieces")
def p10_pieces(spark, d):
    return splitting.split_texts(table(spark, d, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def _session_lines(spark, d, with_text):
    return conversations.codex_lines(table(spark, d, "codex_session"), with_text).unionByName(conversations.droid_lines(table(spark, d, "droid_session"), with_text))


_P5 = r"""WITH lines AS (SELECT DISTINCT 'codex' AS agent, session_id, rollout_path AS file, line_no, timestamp AS ts,
        CASE WHEN type = 'response_item' AND payload.type = 'message' AND len([x FOR x IN payload.content IF coalesce(regexp_matches(x.text, '[^\s\p{Z}\p{C}]'), FALSE)]) > 0
        THEN lower(trim(payload.role)) END AS role FROM codex_session
    UNION ALL SELECT DISTINCT 'droid', session_id, file_path, line_no, timestamp,
        CASE WHEN type = 'message' AND len([x FOR x IN message.content IF coalesce(regexp_matches(x.text, '[^\s\p{Z}\p{C}]'), FALSE)]) > 0
        THEN lower(trim(message.role)) END FROM droid_session),
timed AS (SELECT *, CASE WHEN regexp_full_match(ts, '[0-9]{13}') THEN to_timestamp(CAST(ts AS BIGINT) / 1000.0) ELSE TRY_CAST(ts AS TIMESTAMPTZ) END AS moment,
    CASE WHEN role IN ('user', 'human') THEN 'u' WHEN role IN ('assistant', 'agent', 'model') THEN 'a' END AS who FROM lines),
files AS (SELECT agent, session_id, file, min(moment) AS file_at, min(line_no) <> 1 OR max(line_no) <> count(DISTINCT line_no) AS holes FROM timed GROUP BY ALL),
turns AS (SELECT agent, session_id, coalesce(string_agg(who, '' ORDER BY file_at, file, line_no), '') AS turns, bool_or(holes) AS incomplete
    FROM timed JOIN files USING (agent, session_id, file) GROUP BY agent, session_id)"""


@query("p5_found", _P5 + """
SELECT agent, session_id FROM turns WHERE turns = '' OR turns LIKE 'a%' OR turns LIKE '%uu%' OR turns LIKE '%u' OR incomplete""")
def p5_found(spark, d):
    return conversations.verdicts(conversations.replayed(_session_lines(spark, d, False))).filter("broken").select("agent", "session_id")


_TEXT = "array_to_string([x.text FOR x IN {}.content IF x.text IS NOT NULL], chr(10))"


@query("p5_conversations", _P5 + f""",
told AS (SELECT DISTINCT 'codex' AS agent, session_id, rollout_path AS file, line_no, lower(trim(payload.role)) AS role, {_TEXT.format('payload')} AS text FROM codex_session
    UNION ALL SELECT DISTINCT 'droid', session_id, file_path, line_no, lower(trim(message.role)), {_TEXT.format('message')} FROM droid_session)
SELECT t.agent, t.session_id, row_number() OVER (PARTITION BY t.agent, t.session_id ORDER BY f.file_at, t.file, t.line_no) - 1 AS seq, CASE t.who WHEN 'u' THEN 'user' ELSE 'assistant' END AS role, told.text, t.file, t.line_no
FROM (SELECT DISTINCT agent, session_id, file, line_no, role, who FROM timed WHERE who IS NOT NULL) t JOIN files f USING (agent, session_id, file) JOIN turns USING (agent, session_id) JOIN told ON told.agent = t.agent AND told.session_id = t.session_id AND told.file = t.file AND told.line_no = t.line_no AND told.role = t.role
WHERE NOT (turns = '' OR turns LIKE 'a%' OR turns LIKE '%uu%' OR turns LIKE '%u' OR incomplete)""")
def p5_conversations(spark, d):
    lines = _session_lines(spark, d, True)
    return conversations.messages(conversations.replayed(lines), lines)


def _scans(spark, d):
    return scans.repaired(table(spark, d, "conversion_result"), "result_id", "markdown")


@query("p1_found")
def p1_found(spark, d):
    return scans.noise(*_scans(spark, d), "result_id")


@query("p1_text")
def p1_text(spark, d):
    return scans.corrected(*_scans(spark, d), "result_id").select("result_id", "text")


_MARKED = (("prepared_document", "prepared_id", "canonical_text"), ("conversion_result", "result_id", "markdown"))


def _cleaned(spark, d):
    from pyspark.sql import functions as F
    parts = [markup.cleaned(table(spark, d, t), k, c).select(F.lit(t).alias("origin"), F.col(k).alias("item_id"), "clean_text", "markup") for t, k, c in _MARKED]
    return parts[0].unionByName(parts[1])


@query("p2_found")
def p2_found(spark, d):
    from pyspark.sql import functions as F
    return _cleaned(spark, d).filter("item_id is not null").select("origin", "item_id", F.explode("markup").alias("markup")).distinct()


@query("p2_text")
def p2_text(spark, d):
    return _cleaned(spark, d).select("origin", "item_id", "clean_text")
