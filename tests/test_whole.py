"""Nothing is left out: texts, cells, pages, records and formulas that were once cut off."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import chunking, graph, incremental, retrieval, vectors
from corpusloom.plans.queries import Q


def test_windows_of_texts_with_headings(spark, tmp_path):
    long = "word " * 600
    texts = {1: long, 2: f"# a\n\n{long}\n\n# b\n\nshort", 3: "a #tag", 4: "  "}
    spark.createDataFrame([(i, f"p{i}.md", "t", t) for i, t in texts.items()], "doc_id bigint, source_path string, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q["c04_windows"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert all(r.token_count <= 128 for r in rows) and len([r for r in rows if r.doc_id == 2]) > 5


def test_dates_and_classes_count_in_the_ranking(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "notes/2026-03-01-standup.md", "standup", "team standup plan"), (2, "notes/2026-04-05-standup.md", "standup", "team standup plan"), (3, "research/standup.md", "standup", "team standup plan")],
                                 "doc_id bigint, source_path string, title string, text string")
    ix = retrieval.Index.build(chunking.sections(docs))
    q = spark.createDataFrame([(1, "standup 2026-03-01"), (2, "standup research")], "query_id bigint, query_text string")
    with monkeypatch.context() as m:
        m.setattr(retrieval, "mode_bias", lambda latest: F.lit(0.0))
        plain = {(r.query_id, r.doc_id): r.score for r in ix.ranked_documents(q).collect()}
    got = {(r.query_id, r.doc_id): r for r in ix.ranked_documents(q).collect()}
    more = {k: r.score - plain[k] for k, r in got.items()}
    assert got[1, 1].rank == 1 and more[1, 1] > 0.40 + 0.04 / (1 + 35 / 7) - 1e-9  # the date, and freshness of 35 days
    assert abs(more[2, 3] - 0.14) < 1e-9 and abs(more[2, 2] - 0.04) < 1e-9  # asked for research; the newest of all


def test_eigenpairs_of_tokens_with_many_neighbours(spark):
    r = np.random.default_rng(3)
    for n, most in ((260, 2_000_000), (12, 0)):  # on the driver, and as products in Spark
        a = np.abs(r.standard_normal((n, n)))
        a = a + a.T
        cooc = spark.createDataFrame([(f"t{i}", f"t{j}", float(a[i, j])) for i in range(n) for j in range(n)], "a string, b string, w double")
        got = {x.component: x.eigenvalue for x in vectors.eigenpairs(cooc, most=most).collect()}
        want = np.sort(np.linalg.eigvalsh(a))[::-1]
        assert len(got) == (24 if n == 260 else n - 1) and all(abs(got[c] - want[c]) < 1e-6 * want[0] for c in range(3))


def test_records_after_the_mark(spark):
    cols = "source_key string, wal_sequence bigint, received_ms bigint, file_path string, content_hash string"
    old = [("a", 1, 10, "x", "h1"), ("a", 5, 20, "x", "h5"), ("b", 1, 10, "y", "h1")]
    ledger = [("a", 1, "h1"), ("b", 1, "h1")]
    done = spark.createDataFrame(ledger, "source_key string, wal_sequence bigint, version string")
    low = incremental.low_water(spark.createDataFrame(old, cols), done)  # a: 5 is open; b: nothing
    new = [("a", 3, 30, "z", "h3"), ("b", 2, 30, "w", "h2"), ("b", 0, 31, "v", "h0"), ("c", 1, 5, "u", "h1"), ("c", 2, None, "t", "h2")]
    got = incremental.pending(spark.createDataFrame(old + new, cols), done, low)
    assert {(r.source_key, r.wal_sequence) for r in got.collect()} == {("a", 5), ("a", 3), ("b", 2), ("b", 0), ("c", 1), ("c", 2)}
    assert "low_ms" not in got.columns


def test_descendants_of_whole_tables(spark, tmp_path):
    rows = [("c", "r", None), ("c", "a", "r"), ("c", "b", "a"), ("c", "x", "y"), ("c", "y", "x"), ("c", "z", "y"), ("d", "a", "gone")]
    spark.createDataFrame([(*r, 1.0) for r in rows], "conversation_id string, node_id string, parent string, exported_at double").write.parquet(f"{tmp_path}/chatgpt_node.parquet")
    got = {(r.conversation_id, r.ancestor, r.node_id, r.distance) for r in Q["p4_descendants"](spark, str(tmp_path)).collect()}
    assert got == {("c", "r", "a", 1), ("c", "r", "b", 2), ("c", "a", "b", 1)}


def test_hub_pages_of_large_folders(spark):
    docs = spark.createDataFrame([(i, f"big/{i:02}.md", f"t{i:02}") for i in range(25)] + [(99, "small/a.md", None), (100, "top.md", "x")], "doc_id bigint, source_path string, title string")
    got = {(r.folder, r.number): r for r in graph.hub_pages(docs, 10).collect()}
    assert {k: r.documents for k, r in got.items()} == {("big", 1): 10, ("big", 2): 10, ("big", 3): 5, ("small", 1): 1}
    assert [x for k in (1, 2, 3) for x in got["big", k].page.split("\n")[2:]] == [f"- [[big/{i:02}|t{i:02}]]" for i in range(25)]


def test_cooccurrence_of_over_a_thousand_tokens(spark, tmp_path):
    text = " ".join(f"w{i:04}x" for i in range(1_500))
    spark.createDataFrame([(1, "p.md", "t", text)], "doc_id bigint, source_path string, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {r.a for r in Q["m02_whole_cooccurrence"](spark, str(tmp_path)).collect()}
    assert "w1400x" in seen and len(seen) == 1_500
