"""Queries of the text functions over whole tables."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.registry import query
from corpusloom.session import table

Q = "SELECT DISTINCT query_id, query_text FROM lexical_candidate"
_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
FOLD = "lower(strip_accents({}))"
WORDS = r"'[\p{{L}}\p{{M}}\p{{N}}]+'"
_any = lambda c, xs: "(" + " OR ".join(f"contains({c}, '{x}')" for x in xs) + ")"
FQ = FOLD.format("query_text")
TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
FTOKENS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"
# The same month table, date window and named-date rule in SQL.
MONTH = "CASE " + " ".join(f"WHEN {{0}} IN ({_list(m)}) THEN {k + 1}" for k, m in enumerate(T.MONTHS)) + " END"


def docs(spark, d):
    return table(spark, d, "documents")


def asked(spark, d):
    return table(spark, d, "lexical_candidate").select("query_id", "query_text").distinct()


@query("t01_tokenize", f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY doc_id, token")
def t01(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("t02_fold", f"SELECT doc_id, {FOLD.format('title')} AS folded FROM documents")
def t02(spark, d):
    return docs(spark, d).select("doc_id", T.fold(F.col("title")).alias("folded"))


@query("t03_folded_tokens", f"SELECT doc_id, array_to_string({FTOKENS.format('title')}, ' ') AS terms FROM documents WHERE title IS NOT NULL")
def t03(spark, d):
    return docs(spark, d).filter("title is not null").select("doc_id", F.array_join(T.folded_tokens(F.col("title")), " ").alias("terms"))


@query("t04_stop_words", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) WHERE token IN ({_list(T.STOP)}) GROUP BY token")
def t04(spark, d):
    return docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).filter(T.is_stop(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


_EXACT = f"[t FOR t IN {FTOKENS} IF strlen(t) >= 2 AND t NOT IN ({_list(T.STOP)})]"


@query("t05_exact_terms", f"SELECT query_id, array_to_string({_EXACT.format('query_text')}, ' ') AS terms FROM ({Q})")
def t05(spark, d):
    return asked(spark, d).select("query_id", F.array_join(T.exact_terms(F.col("query_text")), " ").alias("terms"))


@query("t06_recall_intent", f"SELECT doc_id, {_any(FOLD.format('text'), T.RECALL)} AS recall FROM documents WHERE text IS NOT NULL")
def t06(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", T.recall_intent(F.col("text")).alias("recall"))


@query("t07_query_mode", f"""SELECT doc_id, CASE WHEN {_any(FOLD.format('title'), T.LOOKUP)} THEN 'lookup' WHEN {_any(FOLD.format('title'), T.RECALL)} THEN 'recall' ELSE 'concept' END AS mode
FROM documents WHERE title IS NOT NULL""")
def t07(spark, d):
    return docs(spark, d).filter("title is not null").select("doc_id", T.query_mode(F.col("title")).alias("mode"))


ALTS = "CASE " + " ".join(f"WHEN {{0}} IN ({_list(g)}) THEN [{_list(g)}]" for g in T.GROUPS) + " ELSE [{0}] END"


@query("t08_alternatives", f"SELECT DISTINCT term, array_to_string({ALTS.format('term')}, ' ') AS alternatives FROM (SELECT unnest({_EXACT.format('query_text')}) AS term FROM ({Q}))")
def t08(spark, d):
    return asked(spark, d).select(F.explode(T.exact_terms(F.col("query_text"))).alias("term")).distinct().select("term", F.array_join(T.alternatives(F.col("term")), " ").alias("alternatives"))


def dates_sql(src: str, key: str, text: str) -> str:
    """CTEs up to `dated` (key, year, month, day), for the rows of src."""
    return f"""tok AS (SELECT {key} AS k, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT {key}, {FTOKENS.format(text)} AS ts FROM {src})),
num AS (SELECT k, CAST(t AS INT) AS n, row_number() OVER (PARTITION BY k ORDER BY i) AS j FROM tok WHERE regexp_full_match(t, '[0-9]{{1,9}}')),
win AS (SELECT a.k, a.n AS year, b.n AS month, c.n AS day, a.j FROM num a JOIN num b ON b.k = a.k AND b.j = a.j + 1 JOIN num c ON c.k = a.k AND c.j = a.j + 2
    WHERE a.n BETWEEN 1900 AND 2100 AND b.n BETWEEN 1 AND 12 AND c.n BETWEEN 1 AND 31),
f AS (SELECT k, arg_min(year, j) AS year, arg_min(month, j) AS month, arg_min(day, j) AS day FROM win GROUP BY k),
yr AS (SELECT k, arg_min(n, j) AS year FROM num WHERE n BETWEEN 1900 AND 2100 GROUP BY k),
near AS (SELECT m.k, m.i, {MONTH.format('m.t')} AS month, arg_min(CAST(x.t AS INT), CASE WHEN x.i < m.i THEN m.i - x.i ELSE 3 + x.i - m.i END) AS day FROM (SELECT * FROM tok WHERE {MONTH.format('t')} IS NOT NULL) m
    JOIN tok x ON x.k = m.k AND x.i <> m.i AND x.i BETWEEN m.i - 3 AND m.i + 3 WHERE {MONTH.format('m.t')} IS NOT NULL AND regexp_full_match(x.t, '[0-9]{{1,9}}') AND CAST(x.t AS INT) BETWEEN 1 AND 31 GROUP BY ALL),
nm AS (SELECT n.k, arg_min(n.month, n.i) AS month, arg_min(n.day, n.i) AS day FROM near n GROUP BY n.k),
dated AS (SELECT coalesce(f.k, nm.k) AS k, CASE WHEN f.k IS NOT NULL THEN f.year ELSE yr.year END AS year, coalesce(f.month, nm.month) AS month, coalesce(f.day, nm.day) AS day
    FROM f FULL JOIN nm ON nm.k = f.k LEFT JOIN yr ON yr.k = coalesce(f.k, nm.k))"""


@query("t09_date_parts", f"WITH {dates_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, year, month, day FROM dated")
def t09(spark, d):
    return docs(spark, d).select("doc_id", T.date_parts(F.col("text")).alias("p")).filter("p is not null").select("doc_id", "p.*")


@query("t10_date_tokens", f"WITH {dates_sql('documents', 'doc_id', 'source_path')} SELECT k AS doc_id, year, month, day FROM dated WHERE year IS NOT NULL")
def t10(spark, d):
    return docs(spark, d).select("doc_id", T.date_parts(F.col("source_path")).alias("p")).filter("p.year is not null").select("doc_id", "p.*")


@query("t11_date_ordinal", f"WITH {dates_sql('documents', 'doc_id', 'source_path')} SELECT k AS doc_id, CAST(year AS BIGINT) * 372 + month * 31 + day AS ordinal FROM dated WHERE year IS NOT NULL")
def t11(spark, d):
    return docs(spark, d).select("doc_id", T.date_ordinal(T.date_parts(F.col("source_path"))).alias("ordinal")).filter("ordinal is not null")


STEM = r"regexp_replace(regexp_extract({}, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1')"
STRIP = """CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{0,2}}-[0-9]{{0,2}}-') THEN replace(regexp_replace({0}, '^[0-9]{{4}}-[0-9]{{0,2}}-[0-9]{{0,2}}-', ''), '-', ' ')
ELSE translate({0}, '-_', '  ') END"""


@query("t12_strip_date_prefix", f"SELECT doc_id, {STRIP.format(STEM.format('source_path'))} AS name FROM documents")
def t12(spark, d):
    return docs(spark, d).select("doc_id", T.strip_date_prefix(T.file_stem(F.col("source_path"))).alias("name"))


@query("t13_generator_terms", f"""SELECT doc_id, array_to_string([t FOR t IN {TOKENS.format('title')} IF strlen(t) >= 4 AND t NOT IN ({_list(T.GENERATOR_STOP)})], ' ') AS terms
FROM documents WHERE title IS NOT NULL""")
def t13(spark, d):
    return docs(spark, d).filter("title is not null").select("doc_id", F.array_join(T.generator_terms(F.col("title")), " ").alias("terms"))


_CLEAN = """regexp_replace(regexp_replace(trim(regexp_replace(trim(s), '^[#\\-*> ]+', '')), '^`+|`+$', '', 'g'), '^"+|"+$', '', 'g')"""


@query("t15_clean_sentence", f"""SELECT doc_id, CASE WHEN suffix(c, '.') THEN c ELSE c || '.' END AS sentence, regexp_replace(lower(c), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g') AS sentence_key
FROM (SELECT doc_id, {_CLEAN} AS c FROM (SELECT doc_id, split_part(text, chr(10), 1) AS s FROM documents WHERE text IS NOT NULL))""")
def t15(spark, d):
    line = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.trim(line), r"^[#\-*> ]+", "")), "^`+|`+$", ""), '^"+|"+$', "")
    return docs(spark, d).filter("text is not null").select("doc_id", T.clean_sentence(line).alias("sentence"), T.sentence_key(plain).alias("sentence_key"))


@query("t17_frontmatter_tags", f"""WITH f AS (SELECT doc_id, regexp_extract(lower(strip_accents(regexp_extract(regexp_replace(text, '^\\s+', ''), '^---\\n((?:.*\\n)*?)---(?:\\n|$)', 1))), '(?m)^\\s*tags:(.*)$', 1) AS line FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_split_to_array(line, '[,\\[\\] ]')), '^["'']+|["'']+$', '', 'g') AS tag FROM f)
SELECT doc_id, tag FROM p WHERE tag <> ''""")
def t17(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.frontmatter_tags(F.col("text"))).alias("tag"))


@query("t18_hashtags", r"""SELECT DISTINCT result_id, lower(tag) AS tag FROM (SELECT result_id, unnest(regexp_extract_all(markdown, '(?:^|[^\w/])#([\wÀ-ÿ][\wÀ-ÿ/-]*)', 1)) AS tag FROM conversion_result)""")
def t18(spark, d):
    return table(spark, d, "conversion_result").select("result_id", F.explode(T.hashtags(F.col("markdown"))).alias("tag")).distinct()


LINKS = r"""raw AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1))) AS x FROM documents),
parts AS (SELECT doc_id, regexp_extract(x, '^([^|]*)', 1) AS l, CASE WHEN contains(x, '|') THEN regexp_extract(x, '(?s)^[^|]*\|(.*)$', 1) END AS r FROM raw WHERE x <> ''),
links AS (SELECT doc_id, trim(regexp_extract(l, '^([^#]*)', 1)) AS target,
    trim(CASE WHEN NOT contains(l, '#') AND contains(r, '#') THEN regexp_extract(r, '^([^#]*)', 1) ELSE r END) AS display,
    CASE WHEN contains(l, '#') THEN trim(regexp_extract(l, '(?s)^[^#]*#(.*)$', 1)) WHEN contains(r, '#') THEN trim(regexp_extract(r, '(?s)^[^#]*#(.*)$', 1)) END AS anchor FROM parts)"""


@query("t19_wikilinks", f"WITH {LINKS} SELECT doc_id, target, display, anchor, count(*) AS n FROM links GROUP BY ALL")
def t19(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("l")).select("doc_id", "l.*").groupBy("doc_id", "target", "display", "anchor").agg(F.count("*").alias("n"))


CANON = r"regexp_replace(regexp_replace(lower(trim(replace({}, '\', '/'))), '\.md$', ''), '^/+|/+$', '', 'g')"
PSTEM = "trim(regexp_replace(translate(lower(strip_accents(" + STEM + ")), '-_', '  '), '\\s+', ' ', 'g'))"


@query("t20_paths", f"SELECT doc_id, {CANON.format('source_path')} AS canonical, {PSTEM.format('source_path')} AS stem FROM documents")
def t20(spark, d):
    return docs(spark, d).select("doc_id", T.canonical_path(F.col("source_path")).alias("canonical"), T.path_stem(F.col("source_path")).alias("stem"))


@query("t21_normalize_markdown", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
'^\s+|\s+$', '', 'g') || chr(10)) AS digest FROM documents WHERE text IS NOT NULL""")
def t21(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", F.md5(T.normalize_markdown(F.col("text"))).alias("digest"))


@query("t22_names", r"""SELECT doc_id, lower(CASE WHEN f = '' THEN 'document' ELSE left(f, 120) END) AS filename, CASE WHEN g = '' THEN 'chat' ELSE g END AS slug,
'"' || replace(replace(replace(title, '\', '\\'), '"', '\"'), chr(10), ' ') || '"' AS scalar
FROM (SELECT doc_id, title, regexp_replace(regexp_replace(trim(regexp_replace(trim(title), '[^\p{L}\p{M}\p{N}\-_. ]', '-', 'g')), ' +', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS f,
    trim(regexp_replace(title, '[^\p{L}\p{M}\p{N}_\s\-]', '', 'g')) AS g FROM documents WHERE title IS NOT NULL)""")
def t22(spark, d):
    t = F.col("title")
    return docs(spark, d).filter("title is not null").select("doc_id", T.safe_filename(t).alias("filename"), T.slug(t).alias("slug"), T.yaml_scalar(t).alias("scalar"))


@query("t23_provenance", r"""SELECT doc_id, md5('---' || chr(10) || concat_ws(chr(10), 'origin_path: "' || replace(replace(replace(source_path, '\', '\\'), '"', '\"'), chr(10), ' ') || '"',
'origin_language: "' || replace(replace(replace(lang, '\', '\\'), '"', '\"'), chr(10), ' ') || '"') || chr(10) || '---' || chr(10) || chr(10) || coalesce(text, '')) AS digest FROM documents""")
def t23(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.provenance(F.col("text"), {"path": F.col("source_path"), "language": F.col("lang")})).alias("digest"))


@query("t24_levenshtein", f"SELECT a.query_id, a.query_id + 1 AS next_id, CAST(levenshtein(a.query_text, b.query_text) AS BIGINT) AS distance FROM ({Q}) a JOIN ({Q}) b ON b.query_id = a.query_id + 1")
def t24(spark, d):
    a, b = asked(spark, d), asked(spark, d).select((F.col("query_id") - 1).alias("query_id"), F.col("query_text").alias("other"))
    return a.join(b, "query_id").select("query_id", (F.col("query_id") + 1).alias("next_id"), F.levenshtein("query_text", "other").cast("bigint").alias("distance"))


@query("t25_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS excerpt FROM documents")
def t25(spark, d):
    return docs(spark, d).select("doc_id", T.truncated(F.col("text"), 80).alias("excerpt"))


RKEY = r"trim(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("t26_recall", f"""SELECT doc_id, {RKEY.format('title')} AS recall_key, contains({RKEY.format('text')}, {RKEY.format('title')}) AS recalled FROM documents WHERE title IS NOT NULL AND text IS NOT NULL
AND NOT regexp_full_match({RKEY.format('title')}, '[\\p{{N}} ]+')""")
def t26(spark, d):
    t = F.col("title")
    return docs(spark, d).filter("title is not null and text is not null").filter(~T.recall_key(t).rlike(r"^[\p{N} ]+$")).select(
        "doc_id", T.recall_key(t).alias("recall_key"), T.contains_recalled(F.col("text"), t).alias("recalled"))


@query("s28_document_page", """SELECT doc_id, substr(text, CAST(s AS BIGINT) + 1, 500) AS page_text, CAST(s AS INT) AS start, CAST(CASE WHEN s + 500 < n THEN s + 500 END AS INT) AS next_offset, s + 500 < n AS has_more
FROM (SELECT doc_id, text, length(text) AS n, least(300, length(text)) AS s FROM documents WHERE text IS NOT NULL)""")
def s28(spark, d):
    p = T.page(F.col("text"), F.lit(300), F.lit(500))
    return docs(spark, d).filter("text is not null").select("doc_id", p.alias("p")).select("doc_id", F.col("p.text").alias("page_text"), "p.start", "p.next_offset", "p.has_more")


@query("c01_size_profile", """SELECT file_path, size_bytes, CASE WHEN size_bytes < 524288 THEN 512 WHEN size_bytes < 2097152 THEN 1024 WHEN size_bytes < 5242880 THEN 2048 ELSE 3072 END AS tokens,
CASE WHEN size_bytes < 524288 THEN 64 WHEN size_bytes < 2097152 THEN 128 WHEN size_bytes < 5242880 THEN 256 ELSE 384 END AS overlap, count(*) AS n FROM (SELECT file_path, size_bytes * 50 AS size_bytes FROM wal_record WHERE size_bytes IS NOT NULL) GROUP BY ALL""")
def c01(spark, d):
    w = table(spark, d, "wal_record").filter("size_bytes is not null").select("file_path", (F.col("size_bytes") * 50).alias("size_bytes"))
    return w.select("file_path", "size_bytes", T.size_profile(F.col("size_bytes")).alias("p")).groupBy("file_path", "size_bytes", "p.tokens", "p.overlap").agg(F.count("*").alias("n"))


@query("s07_project_name", r"""SELECT doc_id, array_to_string(CASE WHEN lower(p[1]) IN ('users', 'home') AND len(p) > 2 THEN p[3:] ELSE p END, '/') AS project
FROM (SELECT doc_id, string_split(regexp_replace('-home-' || replace(source_path, '/', '-'), '^-+', ''), '-') AS p FROM documents)""")
def s07(spark, d):
    return docs(spark, d).select("doc_id", T.project_name(F.concat(F.lit("-home-"), F.replace("source_path", F.lit("/"), F.lit("-")))).alias("project"))


_HTML = "text"
for _p, _to in ((r"(?is)<script\b.*?</script\s*>", ""), (r"(?is)<style\b.*?</style\s*>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<h[1-6][^>]*>", "\n## "), (r"(?i)</h[1-6]>", "\n"), (r"(?i)<li[^>]*>", "\n- "),
                (r"(?i)</(?:p|div|li|ul|ol|tr)>", "\n"), (r"(?i)</?(?:b|strong)>", "**"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (r"\n{3,}", "\n\n")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_to}', 'g')"


@query("s15_html_text", f"SELECT prepared_id, md5(trim({_HTML})) AS digest FROM (SELECT DISTINCT prepared_id, canonical_text AS text FROM prepared_document WHERE canonical_text IS NOT NULL)")
def s15(spark, d):
    return table(spark, d, "prepared_document").filter("canonical_text is not null").select("prepared_id", "canonical_text").distinct().select("prepared_id", F.md5(T.html_text(F.col("canonical_text"))).alias("digest"))
