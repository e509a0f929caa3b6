import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.engine import Engine
from corpusloom.functions import text as T
from corpusloom.operators import answers, interactions, vectors
from corpusloom.session import clean, cut, move
from corpusloom.streaming import drain
from corpusloom.streaming.trajectories import trajectories, trajectory_stream

DOC = "doc_id bigint, source_path string, title string, text string, n_path int"


def test_engine_from_import_to_answer(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.status().first().documents == 0 and e.query(spark.createDataFrame([(1, "rank")], "query_id int, query_text string")).count() == 0
    docs = spark.createDataFrame([
        (1, "vault/jose-roberto.md", "José Roberto - IT Profile", "# Profile\n\nJosé Roberto leads the platform group and writes about ranking signals.", 0),
        (2, "vault/2026-01-23-daily.md", "Daily", "Met Jose Roberto about the IT profile today. See [[jose-roberto]]. Nothing else happened during the long day.", 0),
        (3, "vault/empty.md", None, None, 0)], DOC)
    assert e.ingest(docs) == 1
    q = spark.createDataFrame([(1, "José Roberto IT profile"), (2, None), (3, "the")], "query_id int, query_text string")
    best = e.query(q).orderBy("rank").collect()
    assert best[0].doc_id == 1 and {r.query_id for r in best} == {1} and all(0 <= r.confidence <= 1 for r in best)
    assert {(r.src, r.dst, r.w) for r in e.links().collect()} == {(2, 1, 1.0), (1, 2, 0.35)}
    assert e.ingest(docs.filter("doc_id = 2").withColumn("text", F.lit("changed entirely"))) == 2
    assert e.documents().count() == 3 and e.document("vault/2026-01-23-daily.md").first().page.text == "changed entirely"
    assert e.sync(docs.filter("doc_id = 1"), "vault") == 3 and e.documents().count() == 1
    assert e.sync(docs.filter("doc_id = 1"), "vault") == 3  # nothing new, nothing written
    before = {(r.token, r.df) for r in e.index().vocab.collect()}
    assert before == {(r.token, r.df) for r in e.index().counted(e.index().post).collect()}  # counts add up over generations
    assert e.ingest(docs) == 4 and e.documents().count() == 3
    assert e.learn(2).select("component").distinct().count() == 2 and e.status().first().learned
    ranked = e.query(q).orderBy("rank").collect()
    assert ranked[0].doc_id == 1 and {r.doc_id for r in ranked} == {1, 2}
    said = {r.query_id: r.answer for r in e.answer_text(q).collect()}
    assert said[3] == answers.NO_TERMS and "Roberto" in said[1]
    shown = e.search(q, 2, 100).orderBy("rank").first()
    assert shown.content.startswith("# Profile") and len(shown.content) <= 101
    n = e.compact()
    assert e.documents().count() == 3 and e.status().first().generation == n
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.md").write_text("# Walks\n\nA note about random walks on graphs.")
    m = e.import_files(f"file://{tmp_path}/files")
    assert m == n + 1 == e.import_files(f"file://{tmp_path}/files") and e.documents().count() == 4
    assert e.index().vocab.filter("token = 'walks'").count() == 1


def test_rules_by_priority_and_cascade(spark):
    rules = [{"class": "review", "path_contains": ["notes"], "priority": 1}, {"class": "guide", "tag_contains": ["Playbook"], "priority": 5}, {"class": "research", "title_contains": ["x"], "priority": 5}]
    df = spark.createDataFrame([("notes/a", "x", ["playbook"]), ("notes/a", None, None), ("other/weekly", "t", [])], "p string, t string, tags array<string>")
    got = [tuple(r) for r in df.select(answers.rule_class(rules, F.col("p"), F.col("t"), F.col("tags"), F.lit("")).alias("r"), answers.memory_class(F.col("p"), F.lit(False)).alias("c")).collect()]
    assert got == [("guide", "other"), ("review", "other"), (None, "summary")]


def test_scores_of_time(spark):
    df = spark.createDataFrame([("2026-04-05", "sprint 2026 4 5"), ("April 5", "sprint 2026 4 5"), ("April 6", "sprint 2026 4 5"), ("2025-04-05", "sprint 2026 4 5"), ("none", "sprint 2026 4 5")], "q string, d string")
    assert [r[0] for r in df.select(answers.temporal_match(T.date_parts(F.col("q")), T.date_parts(F.col("d")))).collect()] == [1.0, 0.8, 0.0, 0.0, 0.0]
    conf = spark.createDataFrame([(0.95, 0.55, 0.9, 0.6), (0.25, 0.20, 0.2, 0.2), (None, None, 1.0, 1.0)], "a double, b double, c double, m double")
    from corpusloom.operators.retrieval import confidence
    hi, lo, none = (r[0] for r in conf.select(confidence(*map(F.col, "abcm"))).collect())
    assert hi > 0.8 and lo < 0.3 and none == 0.0


def test_metrics(spark):
    cases = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "query_id int, doc_id int")
    found = spark.createDataFrame([(1, 10, 1), (2, 99, 1), (2, 20, 2), (3, 30, 9)], "query_id int, doc_id int, rank int")
    m = answers.retrieval_metrics(cases, found).first()
    assert (m.cases, m.hits) == (3, 2) and abs(m.mrr - 0.5) < 1e-12
    v = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 3, 2, None and 0 or 4]], "v double")
    assert {r.quantile: r.v for r in answers.nearest_rank(v, "v", [0.0, 0.5, 0.95]).collect()} == {0.0: 1.0, 0.5: 3.0, 0.95: 5.0}


def test_sentences(spark):
    text = "# Head line\nIt grew by 2.5 percent. Then it stopped! Why?\n| a | b |\n|---|---|\n| 1 | 2 |"
    got = spark.createDataFrame([(text,)], "t string").select(answers.sentences(F.col("t"))).first()[0]
    assert got == ["# Head line", "It grew by 2.5 percent.", "Then it stopped!", "Why?", "| a | b |", "| 1 | 2 |"]


def test_interactions_on_nothing(spark):
    none = spark.createDataFrame([], "query_id string, query_text string, n_clicks bigint, avg_dwell double, status string, created_at timestamp")
    f = interactions.failures(none)
    assert interactions.knowledge_gaps(f).count() == interactions.systemic_issues(f).count() == interactions.diagnostics(f).count() == 0


def test_quantised_and_cosine(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5], [2.0, -2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vectors.quantised(F.col("a")).alias("q"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].q == [32767, -32767, 16384] and abs(got[0].c - 1) < 1e-12 and got[1].c == got[2].c == 0.0


def test_trajectories_stream_with_late_events(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 8)
    rows = [(1, t, "click", 4.0), (1, t + dt.timedelta(hours=5), "error", None), (1, t + dt.timedelta(days=3), "purchase", 1.0), (2, t, "view", None), (3, None, "view", None)]
    df = spark.createDataFrame([rows[k] for k in (2, 3, 4, 0, 1)], "user_id long, ts timestamp, event_type string, value double")  # the newest first
    want = [(1, 1, 0, False), (1, 2, 1, True), (2, 1, 0, False)]
    said = lambda got: sorted((r.user_id, r.events, r.clicks, r.abandoned) for r in got.collect())
    assert said(trajectories(spark, df)) == want and said(trajectories(spark, df.limit(0))) == []


def test_a_stream_that_dies_is_taken_up(spark, tmp_path, monkeypatch):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(k % 7, t + dt.timedelta(days=k), "click", 1.0) for k in range(80)], "user_id long, ts timestamp, event_type string, value double")
    build, marker = (lambda e: trajectory_stream(e, "2 days")), {"ts": "9990-01-01 00:00:00"}
    seen = []
    want = sorted(map(str, drain.replay(spark, df, build, "ts", marker, progress=seen).collect()))
    held, gone = zip(*seen)
    assert len(seen) == 5 and max(held) < 20 and all(gone[:-1])  # each step closes sessions, and the state stays small
    root, moves = f"file://{tmp_path}/replay", []

    def dying(*a):
        if len(moves) == 2:
            raise RuntimeError("killed")
        moves.append(move(*a))

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(drain, "move", dying)
        drain.replay(spark, df, build, "ts", marker, root=root)
    for _ in range(2):  # taken up, then found done
        assert sorted(map(str, drain.replay(spark, df, build, "ts", marker, root=root).collect())) == want


def test_written_tables_are_removed(spark):
    df = cut(spark.range(3), "gone")
    path = df.inputFiles()[0]
    clean(spark)
    import os
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
