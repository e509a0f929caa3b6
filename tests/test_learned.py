import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, chunking, interactions, reflection, retrieval, spectral, vectors
from corpusloom.sources import convert, files, sessions


def test_coherence_confidence_and_solvers():
    assert spectral.coherence(np.array([4.0, 3.0, 1.0])) == 0.25 and spectral.coherence(np.array([1.0])) == 0.0
    assert spectral.matrix_confidence(0.5, 1000) == 0.5 and spectral.matrix_confidence(2.0, 10**9) == 1.0 and spectral.matrix_confidence(0.5, 0) == 0.0
    values, vecs = spectral.solved(np.arange(3), np.arange(3), np.ones(3), 5, 2)
    assert (values == 1).all() and (vecs == np.eye(5)[:, :2]).all()
    r = np.random.default_rng(1)
    a = r.random((30, 30))
    a = a + a.T
    rows, cols = np.nonzero(a)
    s, u = spectral.solved(rows, cols, a[rows, cols], 30, 4)
    assert np.allclose(s, np.linalg.svd(a)[1][:4]) and np.allclose(u.T @ u, np.eye(4)) and (np.take_along_axis(u, np.abs(u).argmax(0)[None], 0) > 0).all()


def test_eigenpairs_are_updated():
    r = np.random.default_rng(2)
    q, _ = np.linalg.qr(r.standard_normal((40, 40)))
    a = (q[:, :3] * [9.0, 6.0, 4.0]) @ q[:, :3].T
    rows, cols, w = np.array([1, 5, 5]), np.array([5, 1, 5]), np.array([0.3, 0.3, 0.2])
    b = a.copy()
    np.add.at(b, (rows, cols), w)
    values, basis, drift = spectral.updated(np.array([9.0, 6.0, 4.0]), q[:, :3], rows, cols, w)
    want, vecs = np.linalg.eigh(b)
    assert np.allclose(values, want[::-1][:3], atol=0.02) and np.allclose(basis.T @ basis, np.eye(3)) and 0 <= drift < 0.05
    assert np.allclose(np.abs((basis * vecs[:, ::-1][:, :3]).sum(0)), 1, atol=0.01)
    same, _, none = spectral.updated(np.array([9.0, 6.0, 4.0]), q[:, :3], rows[:0], cols[:0], w[:0])
    assert np.allclose(same, [9, 6, 4]) and abs(none) < 1e-9


def test_model_against_numpy(spark):
    vec = {"alpha": [1.0, 0.0], "beta": [0.6, 0.8], "gamma": [0.0, 1.0], "delta": [-1.0, 0.0]}
    tv = spark.createDataFrame([(t, v) for t, v in vec.items()], "token string, vec array<double>")
    cooc = spark.createDataFrame([("alpha", "zeta", 2.0), ("beta", "alpha", 0.04)], "a string, b string, w double")
    m = spectral.Model(tv, [3.0, 1.0], cooc, 1000)
    asked = spark.createDataFrame([(1, "alpha"), (1, "nobody"), (2, "nobody")], "query_id int, token string")
    assert [tuple(r) for r in m.projected(asked).collect()] == [(1, [1.0, 0.0])]
    assert {r.token: round(r.score, 9) for r in m.top_tokens(asked, 5).collect()} == {"alpha": 0.75, "beta": 0.45}
    assert [(r.token, round(r.boost, 9)) for r in m.boosts(asked).collect()] == [("zeta", 0.3875)]
    chunks = spark.createDataFrame([(7, 0, "alpha gamma"), (7, 1, "gamma"), (8, 0, "nothing known")], "doc_id long, chunk_index int, content string")
    full = m.with_texts(chunks)
    assert {r.chunk_id: [round(x, 3) for x in r.vec] for r in full.chunk_vectors.collect()} == {7 << 24: [0.707, 0.707], (7 << 24) + 1: [0.0, 1.0]}
    assert [round(x, 3) for x in full.document_vectors.first().vec] == [0.354, 0.854]


def test_cooccurrence_counts_once_and_as_defined(spark, monkeypatch):
    r = np.random.default_rng(5)
    texts = [" ".join(f"t{x}" for x in r.integers(0, 7, n)) for n in (*range(1, 9), 40, 3, 4, 200)] + ["", None, "one", "é a é b é"]
    chunks = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, chunk_index int, content string")
    want = {}
    for t in texts:
        ts = (t or "").split()
        n = len(ts)
        near = [(i, i + o, 0.2) for i in range(2, n - 2) for o in (-2, -1, 1, 2) if ts[i] != ts[i + o]] if n >= 5 else [(i, j, 1 / n) for i in range(n) for j in range(i + 1, n)]
        for i, j, w in near:
            for a, b in {(ts[i], ts[j]), (ts[j], ts[i])}:
                want[a, b] = want.get((a, b), 0.0) + w
    monkeypatch.setattr(vectors, "AT_ONCE", 30)
    found = vectors.cooccurrence(chunks)
    got = {(x.a, x.b): x.w for x in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # the mirror does not count anew


def test_best_pairs_are_the_related_pairs(spark):
    r = np.random.default_rng(6)
    names = [f"n{k:02d}" for k in range(12)]
    cells = {(a, b): float(r.choice([0.04, 0.2, 0.2, 0.4, 3.0, 3.0000000001, 90000.0, 90000.2])) for a in names for b in [*names, *(f"rare{x:03d}" for x in r.integers(0, 300, 60))]}
    cooc = spark.createDataFrame([(a, b, w) for (a, b), w in cells.items()], "a string, b string, w double")
    scores = spark.createDataFrame([(q, str(t), float(s)) for q in range(40) for t, s in zip(r.choice(names, 4, replace=False), r.choice([0.05, 0.1, 0.2, 0.123456789012], 4))], "query_id int, token string, score double")
    rows = lambda df: {(x.query_id, x.a, x.b, x["rank"], round(x.relevance, 12)) for x in df.collect()}
    for top in (5, 20, 500):
        assert rows(vectors.best_pairs(cooc, scores, names, top, 4)) == rows(vectors.related_pairs(cooc, scores, top))
    wanted = scores.select(F.col("token").alias("a")).distinct()
    assert vectors.neighbours(cooc, wanted, names, 9).agg(F.max(F.size("bs"))).first()[0] < 40  # of over 60
    assert vectors.best_pairs(cooc, scores.limit(0), names, 5, 4).count() == 0


def test_a_token_in_every_chunk_is_spread(spark):
    docs = spark.createDataFrame([(k, f"n/{k}.md", f"T{k}", f"common word{k} common") for k in range(400)], "doc_id long, source_path string, title string, text string")
    ix = retrieval.Index.build(chunking.sections(docs))
    q = spark.createDataFrame([(1, "common word7"), (2, "common")], "query_id int, query_text string")
    assert ix.vocab.filter("token = 'common'").first().df == 400 and ix.n_post == 800
    probed = ix._probed(ix.asked(q).alternatives)
    sizes = [r[0] for r in probed.repartition(F.col("token")).groupBy("token").count().select("count").collect()]
    salts = ix.post.filter("token = 'common'").select(F.pmod(F.xxhash64("token", "chunk_id", "length", "tf"), F.lit(64)).alias("s")).groupBy("s").count()
    assert max(sizes) == 800 and salts.count() > 50 and salts.agg(F.max("count")).first()[0] < 30
    best = ix.ranked_documents(q).filter("rank = 1").collect()
    assert {r.query_id: r.doc_id for r in best}[1] == 7


def test_sessions_from_json_lines(spark, tmp_path):
    (tmp_path / "-home-me-alpha-beta").mkdir()
    rows = [{"type": "summary"}, {"type": "user", "cwd": "/w", "gitBranch": "main", "message": {"role": "user", "content": "How does it work?"}}, "broken {",
            {"type": "assistant", "timestamp": "t", "message": {"content": [{"type": "text", "text": "So."}, {"type": "tool_use", "name": "read", "input": {"b": 1, "a": "x"}}, {"type": "text", "text": " "}]}}, {"type": "user", "message": {"content": []}}, {"type": "assistant"}]
    (tmp_path / "-home-me-alpha-beta" / "s1.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")
    got = sessions.claude_messages(sessions.json_lines(spark, f"file://{tmp_path}")).orderBy("line_no").collect()
    assert [(r.session_id, r.project, r.cwd, r.branch, r.line_no, r.role, r.content) for r in got] == [
        ("s1", "alpha/beta", "/w", "main", 2, "user", "How does it work?"), ("s1", "alpha/beta", "/w", "main", 4, "assistant", 'So.\n[tool: read {"a":"x","b":1}]')]
    turn = sessions.claude_turns(spark.createDataFrame(got)).orderBy("line_no").first()
    assert (turn.source_path, turn.content) == ("claude://alpha/beta#s1", "[user → alpha/beta]\nHow does it work?")
    (tmp_path / "codex").mkdir()
    rows = [{"type": "session_meta", "payload": {"id": "abc", "cwd": "/c"}}, {"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": "Hi"}, {"type": "image", "text": "no"}]}},
            {"type": "response_item", "payload": {"role": "system", "content": [{"type": "text", "text": "no"}]}}, {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "<system-reminder>x\ny</system-reminder>Yes"}]}}]
    (tmp_path / "codex" / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = sessions.codex_messages(sessions.json_lines(spark, f"file://{tmp_path}/codex"))
    assert [(r.session_id, r.cwd, r.role, r.content[:2]) for r in got.orderBy("line_no").collect()] == [("abc", "/c", "user", "Hi"), ("abc", "/c", "assistant", "<s")]
    page = sessions.session_markdown(got).first()
    assert page.title == "Hi" and page.text == "# Hi\n\n## User\n\nHi\n\n## Assistant\n\nYes\n"
    assert sessions.codex_messages(got.limit(0).select("path", "line_no", F.col("content").alias("line"))).count() == 0


def test_files_are_converted(spark, tmp_path):
    for name, body in (("a.csv", 'x,y\n1,"two, ""q""\nlines"\n3\n'), ("b.json", '{"b": [1, 2], "a": null}'), ("c.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "code", "source": []}]})),
                       ("d.md", "# Title\n\nbody"), ("e.html", "<h1>Head</h1><p>One</p>"), ("f.pdf", "%PDF"), ("g.tsv", "a\tb|c\n")):
        (tmp_path / name).write_text(body)
    got = {r.source_path.rpartition("/")[2]: r for r in convert.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.csv"].text == '| x | y |\n| --- | --- |\n| 1 | two, "q"<br>lines |\n| 3 |  |' and got["g.tsv"].text == "| a | b\\|c |\n| --- | --- |"
    assert got["b.json"].text.startswith("```json\n{") and json.loads(got["b.json"].text[8:-4]) == {"a": None, "b": [1, 2]}
    assert got["c.ipynb"].text == "# T\ntext\n\n```python\nx = 1\n```" and got["d.md"].title == "Title" and "Head" in got["e.html"].text
    assert (got["f.pdf"].text, got["f.pdf"].converter) == (None, "unsupported")
    manifest = spark.createDataFrame([("k/a", "old"), ("k/gone", "x")], "path string, sha256 string")
    now = spark.createDataFrame([("k/a", bytearray(b"1")), ("k/b", bytearray(b"22")), ("k/big", bytearray(b"x" * 50))], "path string, content binary")
    assert {r.path: r.outcome for r in convert.file_import(manifest, now, 10).collect()} == {"k/a": "updated", "k/b": "imported", "k/gone": "removed", "k/big": "too_large"}
    pages = "Report\none exam-\nple\n1\f Report\ntwo\n2\fReport\nthree\n3"
    assert spark.createDataFrame([(pages,)], "t string").select(convert.cleaned_pages(F.col("t"))).first()[0] == "one example\n1\n\ntwo\n2\n\nthree\n3"


def test_reflection(spark):
    t = spark.createDataFrame([("a", "x y x", 0, None, None, "abandoned"), ("b", "solo", 1, 31.0, False, "completed"), ("c", "p q", 0, 2.0, True, "abandoned"), ("d", None, None, None, None, None)],
                              "query_id string, query_text string, n_clicks int, longest_dwell double, praised boolean, status string")
    assert {r.query_id: (r.succeeded, r.failed) for r in reflection.patterns(t).collect()} == {"a": (False, True), "b": (True, False), "c": (True, True), "d": (False, False)}
    assert sorted(tuple(r) for r in reflection.term_pairs(t).collect()) == [("a", "x", "x", 0.5), ("a", "x", "y", 0.5), ("a", "y", "x", 0.5), ("c", "p", "q", 0.9)]
    edits = spark.createDataFrame([("a", 1, "x", "x y"), ("a", 2, "x y", "x  y z w"), ("b", 1, "p", "p")], "query_id string, at int, original string, reformulated string")
    got = reflection.disambiguation(edits).select("query_id", "original", "added", reflection.edit_quality(F.col("original"), F.col("added")).alias("q")).collect()
    assert [(r.query_id, r.added, round(r.q, 6)) for r in got] == [("a", ["z", "w"], round(0.4 * 0.4 + 0.3 * 3 / 20 + 0.3 / 15, 6))]
    seen = spark.createDataFrame([("A b", "r", 30.0, 1), ("a  B", "r", 90.0, 2), ("a b", "r", 0.0, 3), ("a b", "s", 1e15, 1)], "query_text string, result string, dwell double, at int")
    w = reflection.world_model(seen)
    assert {(r.result, round(r.confidence, 9), r.observations) for r in w.collect()} == {("r", ((0.5 + 0.75) / 2 + 0) / 2, 3), ("s", 1.0, 1)} and reflection.prediction_accuracy(w).first().accuracy == 0.5
    basis = np.eye(4)[:, :2]
    assert reflection.collapse_risk(basis, 10, 0.1, 0.5) is None and reflection.collapse_risk(basis, 10**8, 0.5, 0.5) == "excessive_drift"
    assert reflection.collapse_risk(np.ones((4, 2)) / 2, 4, 0.1, 0.5) == "low_coherence" and reflection.collapse_risk(np.ones((4, 2)), 4, 0.1, 0.96) is None


def test_hypotheses_of_the_last_failures(spark):
    rows = [(f"q{k}", r, k) for k, r in enumerate(["ambiguous_query"] * 5 + ["low_confidence"] * 7 + ["out_of_domain"] * 3)]
    got = reflection.hypotheses(spark.createDataFrame(rows, "query_id string, reason string, created_at int"))
    assert {tuple(r) for r in got.collect()} == {("low_confidence", 7, "add_concepts", 0.7), ("out_of_domain", 3, "change_domain", 0.5)}


def test_consolidation(spark):
    e = np.eye(5)
    assert reflection.subspace_alignment(e[:, :2], e[:, :2]) == 1.0 and reflection.subspace_alignment(e[:, :2], e[:, 2:4]) == 0.0
    with pytest.raises(ValueError):
        reflection.subspace_alignment(e[:, :2], e[:, :3])
    half = np.stack([(e[:, 0] + e[:, 2]) / np.sqrt(2), e[:, 3]], 1)
    assert reflection.coherent_peers("a", {"a": e[:, :2], "b": half, "c": e[:, :2], "d": e[:, 3:5]}) == [("c", 1.0), ("b", pytest.approx(0.7071, abs=1e-4))]
    a, b = (spark.createDataFrame(r, "a string, b string, w double") for r in ([("x", "x", 1.0), ("x", "y", 2.0)], [("x", "y", 4.0)]))
    m, state = reflection.merged_or_kept(a, b, 0.95, 0.01)
    assert state == "merged" and {(r.a, r.b): r.w for r in m.collect()} == {(r.a, r.b): r.w for r in interactions.merged([(a, 0.5), (b, 0.5)]).collect()}
    assert reflection.merged_or_kept(a, b, 0.95, 0.2) == (a, "quarantined") and reflection.merged_or_kept(a, b, 0.1, 0.0) == (a, "separate")


def test_answers_for_every_query(spark):
    qs = spark.createDataFrame([(1, "rank signals"), (2, "the"), (3, "unknown thing")], "query_id int, query_text string")
    results = spark.createDataFrame([(1, 1, 0.25)], "query_id int, rank int, confidence double")
    said = spark.createDataFrame([(1, 1, "v/b.md", "Second."), (1, 0, "v/a.md", "First.")], "query_id int, place int, source_path string, sentence string")
    concepts = spark.createDataFrame([(1, "graph", 2), (1, "walk", 1)], "query_id int, term string, rank int")
    texts = spark.createDataFrame([(1, 1, "# Head one\ntext\n## Head one.\n### Two more\n# x")], "query_id int, rank int, text string")
    got = {r.query_id: (r.answer, r.confidence) for r in answers.answer_texts(qs, results, said, concepts, texts).collect()}
    assert got[1] == ("I have limited knowledge about this topic (confidence: 0.25). From available evidence: First. Second. [Key concepts: walk, graph] [Sections: Head one; Two more] [Sources: a.md, b.md]", 0.25)
    assert got[2] == (answers.NO_TERMS, 0.0) and got[3] == (answers.NO_RESULTS, 0.0)
