"""Queries of sources, upkeep and interactions."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import interactions, sync, vectors
from corpusloom.plans.graph_queries import COOC
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import chunks, r6
from corpusloom.plans.text_queries import STEM, docs
from corpusloom.sources import files
from corpusloom.session import table

_ext = ", ".join(f"'{x}'" for x in files.EXTENSIONS)
_skip = ", ".join(f"'{x}'" for x in files.SKIPPED)


@query("s02_readable_paths", f"""SELECT file_path, (lower(regexp_extract(n, '\\.([^.]+)$', 1)) IN ({_ext}) OR starts_with(n, '.env')) AND NOT list_has_any(string_split(file_path, '/'), [{_skip}]) AND n NOT IN ('.DS_Store', '.vault_index.db') AS readable
FROM (SELECT DISTINCT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS n FROM wal_record WHERE file_path IS NOT NULL)""")
def s02(spark, d):
    return table(spark, d, "wal_record").filter("file_path is not null").select("file_path").distinct().withColumn("readable", files.is_readable(F.col("file_path")))


_IGNORE = ["# drafts", "*/ledger-*.md", "/dripivol/", "backlog-?.md"]


@query("s03_ignored_paths", r"SELECT DISTINCT file_path FROM wal_record WHERE regexp_full_match(file_path, '(?:.*/)?[^/]*/ledger-[^/]*\.md(?:/.*)?|dripivol/.*|(?:.*/)?backlog-[^/]\.md(?:/.*)?')")
def s03(spark, d):
    return table(spark, d, "wal_record").filter(files.ignored(F.col("file_path"), _IGNORE)).select("file_path").distinct()


@query("s10_read_only_sql", "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def s10(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return files.read_only(spark, "-- per customer\nSELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")


@query("s12_row_documents", """SELECT CAST(c_custkey AS VARCHAR) AS doc_key, c_name AS title, '---' || chr(10) || 'c_mktsegment: "' || c_mktsegment || '"' || chr(10) || 'c_nationkey: "' || c_nationkey || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || c_name
|| chr(10) || chr(10) || '## C Name' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || '## C Custkey' || chr(10) || chr(10) || c_custkey || chr(10) AS text FROM customer""")
def s12(spark, d):
    return files.row_documents(table(spark, d, "customer"), "customer", "c_custkey", "c_name", ["c_mktsegment", "c_nationkey"], ["c_name", "c_custkey"])


@query("s14_markdown_table", """SELECT region, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_nationkey::VARCHAR END || ' |', chr(10) ORDER BY n_name) AS md
FROM (SELECT n_regionkey AS region, * FROM nation) GROUP BY region""")
def s14(spark, d):
    line = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat_ws(",", "n_name", F.col("n_nationkey").cast("string")))
    csv = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_name", line.alias("l")))).alias("a"))
    return csv.select("region", files.markdown_table(F.concat(F.lit("name,key\n"), F.array_join(F.transform("a", lambda x: x["l"]), "\n"))).alias("md"))



@query("s18_chat_messages", """SELECT user_id, n - 1 AS n, date_trunc('second', ts) AS sent_at, 'user ' || user_id AS sender, event_type AS body_first FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n FROM events)""")
def s18(spark, d):
    return _chats(spark, d).select("user_id", "n", F.col("at").cast("timestamp_ntz").alias("sent_at"), "sender", F.split_part("body", F.lit("\n"), F.lit(1)).alias("body_first"))


def _chats(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.date_format("ts", "'['d/M/yy, HH:mm:ss'] '"), F.lit("user "), F.col("user_id"), F.lit(": "), F.col("event_type"), F.lit("\nworth "), F.col("value"))
    text = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("l")))).alias("a")).select("user_id", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("text"))
    return files.chat_messages(text, "user_id", "text")


@query("s19_chat_months", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS messages, CAST(1 AS BIGINT) AS senders FROM events GROUP BY user_id, strftime(ts, '%Y-%m')")
def s19(spark, d):
    return files.monthly(_chats(spark, d), "user_id").select("user_id", "month", "messages", "senders")


@query("s22_session_titles", r"""WITH l AS (SELECT DISTINCT session_id, rollout_path, line_no, lower(trim(payload.role)) AS role, array_to_string([c.text FOR c IN payload.content IF c.text IS NOT NULL], chr(10)) AS text FROM codex_session
    WHERE type = 'response_item' AND payload.type = 'message'), u AS (SELECT * FROM l WHERE role IN ('user', 'human') AND trim(text) <> '')
SELECT rollout_path, left(trim(regexp_replace(arg_min(text, line_no), '\s+', ' ', 'g')), 120) AS title, count(*) AS messages, min(line_no) AS first_line FROM u GROUP BY rollout_path""")
def s22(spark, d):
    c = table(spark, d, "codex_session").filter("type = 'response_item' and payload.type = 'message'")
    text = F.array_join(F.filter(F.transform("payload.content", lambda x: x["text"]), lambda x: x.isNotNull()), "\n")
    return files.session_titles(c.select("session_id", "rollout_path", "line_no", F.lower(F.trim("payload.role")).alias("role"), text.alias("text")).distinct(), "rollout_path")


@query("s26_vault_titles", f"SELECT doc_id, CASE WHEN trim(regexp_extract(text, '(?m)^# (.+)$', 1)) <> '' THEN trim(regexp_extract(text, '(?m)^# (.+)$', 1)) ELSE {STEM.format('source_path')} END AS vault_title FROM documents WHERE text IS NOT NULL")
def s26(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", files.vault_title(F.col("text"), F.col("source_path")).alias("vault_title"))


_DIFF = """WITH once AS (SELECT DISTINCT source_key, file_path, wal_sequence, size_bytes, content_hash FROM wal_record WHERE file_path IS NOT NULL),
x AS (SELECT * FROM (SELECT source_key, file_path, arg_max(coalesce(content_hash, ''), wal_sequence) AS h FROM once WHERE wal_sequence <= 20 GROUP BY ALL) WHERE h <> ''),
y AS (SELECT * FROM (SELECT source_key, file_path, arg_max(coalesce(content_hash, ''), wal_sequence) AS h FROM once GROUP BY ALL) WHERE h <> ''),
diff AS (SELECT coalesce(x.source_key, y.source_key) AS source_key, coalesce(x.file_path, y.file_path) AS file_path, CASE WHEN x.h IS NULL THEN 'added' WHEN y.h IS NULL THEN 'removed' WHEN x.h = y.h THEN 'unchanged' ELSE 'modified' END AS change
    FROM x FULL JOIN y ON y.source_key = x.source_key AND y.file_path = x.file_path)"""


def _snapshots(spark, d):
    once = table(spark, d, "wal_record").filter("file_path is not null").select("source_key", "file_path", "wal_sequence", "size_bytes", "content_hash").distinct()
    return tuple(sync.snapshot(o, ["source_key", "file_path"], "wal_sequence") for o in (once.filter("wal_sequence <= 20"), once))


def _diff(spark, d):
    return sync.manifest_diff(*_snapshots(spark, d), ["source_key", "file_path"], ["content_hash"])


@query("i02_manifest_diff", _DIFF + " SELECT * FROM diff")
def i02(spark, d):
    return _diff(spark, d)


@query("i03_incremental_sync", _DIFF + " SELECT source_key, file_path, h AS content_hash FROM y")
def i03(spark, d):
    before, after = _snapshots(spark, d)
    cols = ["source_key", "file_path", "content_hash"]
    return sync.replaced(before.select(*cols), after.select(*cols), _diff(spark, d), ["source_key", "file_path"])


@query("i05_source_membership", """SELECT doc_id, source_path = 'folder/scans' OR starts_with(source_path, 'folder/scans/') AS in_folder, source_path = 'codex/x.md' AS is_file FROM documents""")
def i05(spark, d):
    p = F.col("source_path")
    return docs(spark, d).select("doc_id", sync.belongs(p, F.lit("folder"), F.lit("folder/scans/")).alias("in_folder"), sync.belongs(p, F.lit("file"), F.lit("codex/x.md")).alias("is_file"))


@query("i07_row_import", """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'imported' WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'skipped' END AS outcome
FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0""")
def i07(spark, d):
    cols = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), *cols)
    k = F.col("o_orderkey")
    before = o.filter(k % 7 != 0).select("o_orderkey", sync.row_hash(cols).alias("hash"))
    now = o.filter(k % 13 != 0)
    now = now.unionByName(now.filter(k % 11 == 0)).withColumn("o_orderpriority", F.when(k % 5 == 0, F.lit("new")).otherwise(F.col("o_orderpriority")))
    return sync.row_import(before, now, "o_orderkey", cols)


@query("i10_status", "SELECT count(*) AS documents, count(text) AS texts, count(DISTINCT source) AS sources, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM documents")
def i10(spark, d):
    return docs(spark, d).agg(F.count("*").alias("documents"), F.count("text").alias("texts"), F.count_distinct("source").alias("sources"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


_dom = ", ".join(f"'{x}'" for x in interactions.DOMAINS)
TRAJECTORIES = f"""tr AS (SELECT user_id || '-' || CAST(ts AS DATE) AS query_id, CASE WHEN user_id % 16 < 15 THEN [{_dom}][user_id % 16 + 1] || ' ' ELSE '' END || string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS query_text,
    count(*) FILTER (event_type = 'click') AS n_clicks, avg(value) FILTER (event_type = 'click') AS avg_dwell, CASE WHEN bool_or(event_type = 'error') AND NOT bool_or(event_type = 'purchase') THEN 'abandoned' ELSE 'completed' END AS status, max(ts) AS created_at
    FROM events GROUP BY user_id, CAST(ts AS DATE)),
dm AS (SELECT unnest([{_dom}]) AS k, generate_subscripts([{_dom}], 1) AS o),
fl AS (SELECT *, CASE WHEN NOT contains(trim(query_text), ' ') THEN 'ambiguous_query' WHEN n_clicks = 0 THEN 'out_of_domain' ELSE 'low_confidence' END AS reason,
    coalesce((SELECT arg_min(k, o) FROM dm WHERE contains(lower(query_text), k)), 'unknown') AS domain FROM tr WHERE status = 'abandoned')"""


def trajectories(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    word = F.get(F.array(*[F.lit(x) for x in interactions.DOMAINS]), (F.col("user_id") % 16).cast("int"))
    click = F.col("event_type") == "click"
    return e.groupBy("user_id", "day").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("types"), F.count(F.when(click, 1)).alias("n_clicks"), F.avg(F.when(click, F.col("value"))).alias("avg_dwell"),
        F.when(F.max((F.col("event_type") == "error").cast("int")).eqNullSafe(1) & (F.max((F.col("event_type") == "purchase").cast("int")) == 0), "abandoned").otherwise("completed").alias("status"), F.max("ts").alias("created_at"),
    ).select(F.concat_ws("-", "user_id", F.col("day").cast("string")).alias("query_id"), F.when(F.col("user_id") % 16 < 15, F.concat_ws(" ", word, "types")).otherwise(F.col("types")).alias("query_text"), "n_clicks", "avg_dwell", "status", "created_at")


def failed(spark, d):
    return interactions.failures(trajectories(spark, d))


@query("f01_failures", f"WITH {TRAJECTORIES} SELECT query_id, reason, domain FROM fl")
def f01(spark, d):
    return failed(spark, d).select("query_id", "reason", "domain")


@query("f02_window_stats", f"""WITH {TRAJECTORIES}, w AS (SELECT * FROM (VALUES ('1h', 1), ('24h', 24), ('7d', 168)) v(span, h)),
i AS (SELECT span, h, reason, count(*) AS n FROM fl, w WHERE created_at >= (SELECT max(created_at) FROM fl) - to_hours(h) GROUP BY ALL),
t AS (SELECT span, h, CAST(sum(n) AS BIGINT) AS total, min({{'k': -n, 'r': reason}}) AS m FROM i GROUP BY span, h)
SELECT span, total, CAST(round(total / h, 6) AS DOUBLE) AS rate, m.r AS reason, CASE WHEN total < 2 THEN NULL WHEN total % 2 = 1 THEN 'increasing' ELSE 'stable' END AS trend FROM t""")
def f02(spark, d):
    return r6(interactions.window_stats(failed(spark, d), {"1h": 1, "24h": 24, "7d": 168}).withColumnRenamed("window", "span"), "rate")


@query("f03_knowledge_gaps", f"""WITH {TRAJECTORIES}, o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at, query_id) AS k FROM fl WHERE reason = 'out_of_domain')
SELECT domain, count(*) AS failures, string_agg(query_text, '; ' ORDER BY k) FILTER (k <= 3) AS examples, CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END AS severity FROM o GROUP BY domain HAVING count(*) >= 5""")
def f03(spark, d):
    return interactions.knowledge_gaps(failed(spark, d))


_ISSUES = """iss AS (SELECT issue, affected, CASE WHEN issue = 'ranking_quality' AND affected >= 20 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT 'ranking_quality' AS issue, count(*) FILTER (n_clicks > 0 AND avg_dwell < 10) AS affected FROM fl
    UNION ALL SELECT 'query_ambiguity', count(*) FILTER (reason = 'ambiguous_query') FROM fl) WHERE affected >= 10)"""


@query("f04_systemic_issues", f"WITH {TRAJECTORIES}, {_ISSUES} SELECT * FROM iss")
def f04(spark, d):
    return interactions.systemic_issues(failed(spark, d))


@query("f05_diagnostics", f"""WITH {TRAJECTORIES}, {_ISSUES}, g AS (SELECT domain, count(*) AS n FROM fl WHERE reason = 'out_of_domain' GROUP BY domain HAVING count(*) >= 5),
a AS (SELECT 'knowledge_gap' AS kind, 'Knowledge gap in ''' || domain || ''' domain' AS title, CASE WHEN n >= 15 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS severity FROM g UNION ALL SELECT 'systemic_issue', issue, severity FROM iss)
SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, kind, title) AS INT) AS place FROM a""")
def f05(spark, d):
    return interactions.diagnostics(failed(spark, d))


@query("f07_distribution_shift", """WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id DESC) <= 100 AS late FROM embeddings), l AS (SELECT late, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM e),
p AS (SELECT k, avg(x) FILTER (late) AS a, avg(x) FILTER (NOT late) AS b, var_pop(x) FILTER (NOT late) AS v FROM l GROUP BY k), o AS (SELECT sqrt(sum(power(a - b, 2))) AS distance, sqrt(avg(v)) AS spread FROM p)
SELECT round(distance, 6) AS distance, round(spread, 6) AS spread, round(distance / (spread + 1e-6), 6) AS score, distance / (spread + 1e-6) > 0.3 AS shifted FROM o""")
def f07(spark, d):
    return r6(interactions.distribution_shift(table(spark, d, "embeddings"), "vec_id", "embedding", 100), "distance", "spread", "score")


@query("a13_series_statistics", """WITH s AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM s)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(regr_slope(v, i), 6) AS slope, round(min(v), 6) AS least, round(max(v), 6) AS most, round(arg_max(v, i) - arg_min(v, i), 6) AS delta FROM i""")
def a13(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return r6(interactions.series_statistics(s, "day", "v"), "mean", "deviation", "slope", "least", "most", "delta")


@query("m23_states", "SELECT chunk_idx, query_id, CASE WHEN c > 0.5 THEN 'healthy' WHEN c > 0.3 THEN 'degraded' ELSE 'quarantined' END AS state, CASE WHEN c < 0.3 THEN 'exploration' WHEN c < 0.7 THEN 'consolidation' ELSE 'exploitation' END AS phase FROM (SELECT DISTINCT query_id, chunk_idx, query_coverage AS c FROM lexical_candidate WHERE query_coverage IS NOT NULL)")
def m23(spark, d):
    c = table(spark, d, "lexical_candidate").filter("query_coverage is not null").select("query_id", "chunk_idx", F.col("query_coverage").alias("c")).distinct()
    return c.select("chunk_idx", "query_id", interactions.health(F.col("c")).alias("state"), interactions.learning_phase(F.col("c")).alias("phase"))


@query("x01_merge", f"WITH {COOC} SELECT a, b, CAST(round(w * CASE WHEN a = b THEN 1 ELSE 2 END, 6) AS DOUBLE) AS w FROM cooc")
def x01(spark, d):
    c = vectors.cooccurrence(chunks(spark, d))
    return r6(interactions.merged([(c, 0.25), (c, 0.75)]), "w")


@query("f15_curate", f"WITH {COOC} SELECT a, b, CAST(round(w + w * 0.1 * 1.125, 6) AS DOUBLE) AS w FROM cooc")
def f15(spark, d):
    c = vectors.cooccurrence(chunks(spark, d))
    return r6(interactions.curated(c, c.select("a", "b", F.col("w").alias("delta"), F.lit(0.75).alias("confidence")), 0.1), "w")


_WORDS = "list_distinct([t FOR t IN regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+') IF strlen(t) >= 4 AND t NOT IN (" + ", ".join(f"'{x}'" for x in T.GENERATOR_STOP) + ")])"


@query("n07_jaccard", f"""WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id, CAST(round(CASE WHEN len(a.ws) + len(b.ws) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) END, 6) AS DOUBLE) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def n07(spark, d):
    t = docs(spark, d).filter("text is not null").select("doc_id", F.array_distinct(T.generator_terms(F.col("text"))).alias("ws"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("vs"))
    j = F.size(F.array_intersect("ws", "vs")) / F.size(F.array_union("ws", "vs"))
    return t.join(b, "doc_id").select("doc_id", F.round(F.when(F.size("ws") + F.size("vs") == 0, 0.0).otherwise(j), 6).alias("jaccard"))
