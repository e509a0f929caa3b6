import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, graph, retrieval, skew, sync, vectors
from corpusloom.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("t")), t="Auth, JWT/refresh-token rotation!") == ["auth", "jwt", "refresh", "token", "rotation"]
    assert one(spark, T.fold(F.col("t")), t="Decisão ÉÇ é") == "decisao ec e"
    for text, want in (("on August 3, what changed?", (None, 8, 3)), ("24 de março de 2026", (2026, 3, 24)), ("sprint 9 on 2026-04-05", (2026, 4, 5)), ("nothing here", None)):
        got = one(spark, T.date_parts(F.col("t")), t=text)
        assert (None if got is None else tuple(got)) == want
    assert [tuple(x) for x in one(spark, T.wikilinks(F.col("t")), t="[[Target Page|Alias Text#section]] and [[second/path#heading]]")] == [("Target Page", "Alias Text", "section"), ("second/path", None, "heading")]
    assert tuple(one(spark, T.page(F.col("t"), F.lit(7), F.lit(3)), t="# Ação\náβcdef")) == ("áβc", 7, 10, True)
    assert one(spark, T.clean_sentence(F.col("t")), t="## - `done`") == "done."
    assert one(spark, T.evidence_text(F.col("t")), t="---\na: b\n---\nx\n<!-- nav:start -->\n[[y]]\n<!-- nav:end -->\n\n\nz  ") == "x\n\nz"


def test_nulls_stay_null(spark):
    for f in (T.tokens, T.fold, T.folded_tokens, T.exact_terms, T.wikilinks, T.canonical_path, T.normalize_markdown, T.date_parts, T.frontmatter_tags, T.html_text):
        assert one(spark, f(F.col("t")), t=None) is None


def test_chunker(spark):
    docs = spark.createDataFrame([(1, "p", "t", "intro\n# A\nx\n## B\n\n# C\ny"), (2, "p", None, "# Only\nbody"), (3, "p", None, None), (4, "p", None, "  \n "), (5, "p", None, "é" * 3000)],
                                 "doc_id bigint, source_path string, title string, text string")
    got = {(r.doc_id, r.chunk_index): (r.section_title, r.content) for r in chunking.sections(docs).collect()}
    assert got[1, 0] == (None, "intro\n") and got[1, 1] == ("A", "## A\n\nx\n") and got[1, 2] == ("C", "## C\n\ny") and got[2, 0] == (None, "# Only\nbody")
    assert {d for d, _ in got} == {1, 2, 5}
    parts = [r.content for r in chunking.chunks(docs).filter("doc_id = 5").orderBy("chunk_index").collect()]
    assert all(len(p.encode()) <= 2048 and set(p) == {"é"} for p in parts) and len(parts) > 2
    assert chunking.windows("One. Two. " * 300, 64, 8)[0].endswith(".")
    assert chunking.packed_paragraphs("a\n\nb\n\n" + "c" * 30, 4, 1)[0] == "a\n\nb"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(2, 20))
def test_windows_lose_nothing(text, tokens):
    joined = "".join("".join(chunking.windows(text, tokens, 0)).split())
    assert joined == "".join(text.split())


def test_split_cumulate_and_salted_join(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), k, r.random(), r.randrange(5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v double, w int")
    got = {x.k: x.c for x in skew.split_cumulate(df, ["g"], [F.col("v")], "w", "c").collect()}
    for g in ("hot", "a", None):
        total = 0
        for _, k, _, w in sorted((x for x in rows if x[0] == g), key=lambda x: x[2]):
            assert got[k] == total
            total += w
    right = df.filter("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    assert skew.salted_join(df, right, ["g"], "n", len(rows)).filter("n is not null").count() == sum(x[0] is not None for x in rows)


def test_bm25_rises_with_frequency_and_candidates_in_range(spark):
    docs = spark.createDataFrame([(1, "p1", None, "seven seven seven"), (2, "p2", None, "one two three four five six seven eight"), (3, "p3", None, "nothing")], "doc_id bigint, source_path string, title string, text string")
    ix = retrieval.Index.build(chunking.sections(docs))
    q = spark.createDataFrame([(1, "seven"), (2, ""), (3, None)], "query_id bigint, query_text string")
    got = ix.candidates(q).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1 << 24, 2 << 24] and all(0 <= r.lexical <= 1 for r in got) and got[0].coverage == 1.0
    ranked = ix.ranked_documents(q).orderBy("rank").collect()
    assert ranked[0].doc_id == 1 and all(0 <= r.confidence <= 1 for r in ranked)


def test_metadata_only_recall_and_numbers_first(spark):
    docs = spark.createDataFrame([(k, f"memory/generic-{k}.md", None, "sprint notes " * 5) for k in range(20)] + [(99, "2026-04-05-sprint.md", None, "short")], "doc_id bigint, source_path string, title string, text string")
    ix = retrieval.Index.build(chunking.sections(docs))
    q = spark.createDataFrame([(1, "sprint 2026 04 05")], "query_id bigint, query_text string")
    first = ix.candidates(q, 1).collect()
    assert [r.chunk_id for r in first] == [99 << 24] and first[0].tier == 0


def test_links_and_walks(spark):
    docs = spark.createDataFrame([(1, "hub.md", "h", "[[child-a]] [[x/child-b#p|B]]"), (2, "x/child-a.md", "a", "[[hub]]"), (3, "x/child-b.md", "b", "[[hub]] [[none]]"), (4, "lonely.md", "l", None)],
                                 "doc_id bigint, source_path string, title string, text string")
    links = graph.resolved_links(docs)
    assert {(r.doc_id, r.target_id) for r in links.collect()} == {(1, 2), (1, 3), (2, 1), (3, 1)}
    assert {r.doc_id for r in graph.orphans(docs, links).collect()} == {4}
    assert {r.target for r in graph.dead_links(docs).collect()} == {"none"}
    rank = {r.doc_id: r.rank for r in graph.pagerank(docs, links).collect()}
    assert max(rank, key=rank.get) == 1 and abs(sum(rank.values()) - 1) < 1e-9
    seeds = spark.createDataFrame([(7, 2, 1.0), (7, 4, 1.0)], "query_id bigint, doc_id bigint, score double")
    got = {r.doc_id: r.graph for r in graph.spread(graph.edges(links), seeds, 10).collect()}
    assert max(got.values()) == 1.0 and got[4] > 0 and set(got) == {1, 2, 3, 4}


def test_cooccurrence_is_symmetric_and_lanczos_solves(spark):
    docs = spark.createDataFrame([(1, "p", None, "a b c d e f a b"), (2, "p", None, "x x y")], "doc_id bigint, source_path string, title string, text string")
    m = {(r.a, r.b): r.w for r in vectors.cooccurrence(chunking.sections(docs)).collect()}
    assert all(abs(m[b, a] - w) < 1e-12 for (a, b), w in m.items()) and abs(m["x", "x"] - 1 / 3) < 1e-12 and abs(m["x", "y"] - 2 / 3) < 1e-12
    a = np.random.default_rng(0).random((40, 40))
    a = a + a.T
    r, c = np.nonzero(a)
    values, vecs = vectors.lanczos(r, c, a[r, c], 40, 4)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:4]) and np.allclose(a @ vecs, vecs * values, atol=1e-8)


def test_sync_and_generations(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "k string, h string")
    diff = sync.manifest_diff(old, new, ["k"], ["h"])
    assert {tuple(r) for r in diff.collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "unchanged"), ("d", "added")}
    assert {tuple(r) for r in sync.replaced(old, new, diff, ["k"]).collect()} == {tuple(r) for r in new.collect()}
    root = f"file://{tmp_path}/store"
    assert sync.published(spark, root, "t") is None
    assert sync.publish(spark, root, {"t": old}) == 1 and sync.publish(spark, root, {"t": new}) == 2
    assert sync.published(spark, root, "t").count() == 4
    assert sync.publish(spark, root, {"t": old}, added=True) == 3 and sync.published(spark, root, "t").count() == 7
    df = spark.createDataFrame([("folder/a/x", "folder", "folder/a"), ("folder/ab", "folder", "folder/a"), ("codex://s", "codex", "")], "p string, k string, r string")
    assert [r[0] for r in df.select(sync.belongs(F.col("p"), F.col("k"), F.col("r"))).collect()] == [True, False, True]
    assert one(spark, sync.interval_seconds(F.col("t")), t="2h") == 7200 and one(spark, sync.interval_seconds(F.col("t")), t="soon") is None


def test_sources(spark, tmp_path):
    (tmp_path / "private").mkdir()
    for name in ("a.md", "b.log", "c.bin", "private/d.md"):
        (tmp_path / name).write_text("x")
    (tmp_path / "empty.md").write_text("")
    got = {r.path.rsplit("/", 1)[1] for r in files.discover(spark, f"file://{tmp_path}", ["*.log", "/private/"]).collect()}
    assert got == {"a.md"}
    chat = spark.createDataFrame([(1, "[3/4/26, 10:00:00] Ana: hi\nmore\n[3/4/2026, 10:01:00] Bo: ok"), (2, None), (3, "no message")], "k int, t string")
    rows = files.chat_messages(chat, "k", "t").orderBy("n").collect()
    assert [(r.sender, r.body) for r in rows] == [("Ana", "hi\nmore"), ("Bo", "ok")] and rows[0].at.year == 2026
    for bad in ("delete from t", "select 1; select 2"):
        try:
            files.read_only(spark, bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_core_needs_no_llm():
    import pathlib
    import re
    root = pathlib.Path(__file__).parents[1] / "corpusloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"corpusloom\.llm|from \.+llm", f.read_text()), f


def test_a_write_that_dies_leaves_the_generation_before(spark, tmp_path, monkeypatch):
    root, t = f"file://{tmp_path}/store", spark.range(3)
    sync.publish(spark, root, {"t": t})

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(sync, "put_new", die)
        sync.publish(spark, root, {"t": spark.range(9)})
    assert sync.published(spark, root, "t").count() == 3
    (tmp_path / "store" / "generations" / "0000000002").write_text('{"generation": 2, "tab')  # half a marker
    assert sync.state(spark, root)["generation"] == 1 and sync.published(spark, root, "t").count() == 3
    assert sync.publish(spark, root, {"t": spark.range(9)}) == 3 and sync.published(spark, root, "t").count() == 9
    import shutil
    shutil.rmtree(tmp_path / "store" / sync.state(spark, root)["tables"]["t"][0])
    assert sync.published(spark, root, "t").count() == 3


@pytest.mark.parametrize("sql", ["INSERT INTO t_ro VALUES (1)", "WITH x AS (SELECT 1 a) INSERT INTO t_ro SELECT * FROM x", "-- note\nWITH x AS (SELECT 1 a) FROM x INSERT INTO t_ro SELECT *",
                                 "DROP TABLE t_ro", "SET a=1", "SELECT 1; DROP TABLE t_ro", "CACHE TABLE v", "CREATE TABLE q AS SELECT 1", "TRUNCATE TABLE t_ro"])
def test_only_queries_are_read(spark, sql):
    with pytest.raises(Exception):
        files.read_only(spark, sql)
    assert files.read_only(spark, "-- note\nWITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r").count() == 5
