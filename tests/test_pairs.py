"""Scores of pairs of queries and rows are made block by block; what leaves the blocks is right, and little."""

import pytest

from corpusloom.operators import answers, chunking, pairs, retrieval
from corpusloom.session import cut


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["orange", "pear", "plum", "fig"]
    rows = [(i, f"n/{i}.md", f"Note {words[i % 4]}", " ".join(words[: i % 4 + 1] * (i % 7 + 1)) + " and filler" * (i % 5)) for i in range(40)]
    docs = cut(spark.createDataFrame(rows, "doc_id bigint, source_path string, title string, text string"))
    asked = cut(spark.createDataFrame([(q, f"{words[q % 4]} beside {words[(q + 1) % 4]}") for q in range(12)], "query_id bigint, query_text string"))
    return docs, asked


@pytest.fixture
def written(monkeypatch):
    """The sizes of the tables that ranking writes; blocks are small."""
    sizes = []

    def counted(df, name="cut"):
        back = cut(df, name)
        sizes.append((name, back.count()))
        return back

    for module in (retrieval, pairs):
        monkeypatch.setattr(module, "cut", counted)
    for name in ("ROWS", "QUERIES"):
        monkeypatch.setattr(pairs, name, 10 if name == "ROWS" else 5)
    return sizes


def test_q07_candidates_write_no_row_a_pair(corpus, written):
    docs, asked = corpus
    ix = retrieval.Index.for_queries(chunking.sections(docs), asked)
    of = lambda df: {(r.query_id, r.chunk_id): r for r in df.collect()}
    all_, best = of(ix.scored(asked)), of(ix.candidates(asked, 7))
    assert max(n for _, n in written) < len(all_)
    for q in range(12):
        mine = sorted((r.tier, -round(r.prefilter, 9), c) for (k, c), r in all_.items() if k == q)
        assert [(r.rank, c) for (k, c), r in sorted(best.items(), key=lambda x: x[1].rank) if k == q] == [(i + 1, c) for i, (_, _, c) in enumerate(mine[:7])]


def test_q28_baseline_by_blocks(corpus, written):
    docs, asked = corpus
    found = answers.fielded_baseline(docs, asked, 5).collect()
    assert {n for n, _ in written} >= {"blocks", "bounds"} and max(n for _, n in written) < 12 * 40
    assert all(sorted(r.rank for r in found if r.query_id == q) == [1, 2, 3, 4, 5] for q in range(12))


def test_f4_q11_texts_are_read_once_and_features_read_what_they_need(corpus, written):
    docs, asked = corpus
    ix = retrieval.Index.for_queries(chunking.sections(docs), asked)
    assert ix.profile.inputFiles() and not set(ix.profile.inputFiles()) & set(docs.inputFiles())
    f = ix.featured(asked)
    plan = f.select("query_id", "chunk_id", "compactness")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "regexp" not in plan
    all_ = f.select("score", "metadata_overlap").collect()
    assert len(all_) and all(r.score > 0 for r in all_)


def test_f4_of_alternatives_the_best_counts(corpus, spark):
    """A chunk with two alternatives of a term has it once, with the higher score, without a shuffle for it."""
    docs = cut(spark.createDataFrame([(1, "a.md", "A", "plan plans plans planning"), (2, "b.md", "B", "plan and more"), (3, "c.md", "C", "fig")], "doc_id bigint, source_path string, title string, text string"))
    asked = cut(spark.createDataFrame([(1, "plan fig")], "query_id bigint, query_text string"))
    ix = retrieval.Index.for_queries(chunking.sections(docs), asked)
    a = ix.asked(asked)
    assert a.hits.count() > a.term_scores.count()
    lists = [x for r in pairs.packed_rows(a.said(), 3).collect() for x in r.lists if x.kind == pairs.CONTENT]
    got = {(x.term, s, i) for x in lists for s, i in zip(x.score, x.idf)}
    assert got == {(r.grp, r.score, r.idf) for r in a.term_scores.collect()} and sum(len(x["at"]) for x in lists) == a.term_scores.count()


def test_f5_q14_paths_are_not_counted_for_a_name(corpus):
    docs, asked = corpus
    f = retrieval.Index.for_queries(chunking.sections(docs), asked).featured(asked)
    plan = lambda c: f.select("query_id", "chunk_id", c)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_path" in plan("compactness") and "n_path" not in plan("entity")
    assert {r.compactness for r in f.select("compactness").collect()} == {1.0}


def test_f13_q09_pairs_are_not_joined(corpus, written):
    """A pair leaves its block with the number of the query's terms; no pair is shuffled."""
    docs, asked = corpus
    s = retrieval.Index.for_queries(chunking.sections(docs), asked).document_scores(asked)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.index("Join") > plan.index("MapInArrow") and plan.count("Join") == plan.count("Join Cross")
    assert {round(r.doc_coverage, 6) for r in s.collect()} <= {0.333333, 0.666667, 1.0}


def test_f14_q12_nothing_but_terms_and_metadata_is_joined(corpus):
    docs, asked = corpus
    f = retrieval.Index.for_queries(chunking.sections(docs), asked).featured(asked)
    plan = f.select("query_id", "chunk_id", "exact_bonus")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_path" not in plan and "aliases" not in plan and "lexical" not in plan.split("MapInArrow")[0]


def test_f6_q20_shares_of_words_are_made_in_the_blocks(spark):
    """They are those of the arrays, for accents, numbers and ids that are not unique; candidates are not joined with words for them."""
    rows = [(1, "n/Canción del río 2024.md", "Canción", "rio cancion plan"), (2, "n/cancion-del-rio.md", "Cancion Rio 2024", "rio other"), (3, "n/a.md", "--", "plan 2024 rio"), (4, "n/étude.md", "Plan Rio", "etude of plan")]
    docs = cut(spark.createDataFrame(rows, "doc_id bigint, source_path string, title string, text string"))
    texts = [(1, "canción del río 2024"), (2, "plan rio"), (3, "etude plan"), (4, "2024"), (5, "étude")]
    asked = cut(spark.createDataFrame(texts, "query_id bigint, query_text string"))
    names = ["query_id", "chunk_id", "metadata_overlap", "exact_bonus", "exactness", "entity", "score"]

    def of(docs, asked, shares=True):
        ix = retrieval.Index.for_queries(chunking.sections(docs), asked)
        found = None if shares else ix.candidates(asked)
        return ix.featured(asked, found=found).select(names)

    made = of(docs, asked)
    assert sorted(made.collect()) == sorted(of(docs, asked, False).collect()) and made.count()
    assert {(r.query_id, r.chunk_id >> 24): r.metadata_overlap for r in made.collect()}[2, 4] == 1.0
    plan = made.select("query_id", "metadata_overlap", "exact_bonus")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "array_except" not in plan
    twice = cut(docs.union(spark.createDataFrame([(4, "n/z.md", "Etude", "plan")], docs.schema)))
    two = cut(asked.union(spark.createDataFrame([(2, "etude of 2024")], asked.schema)))
    for d, a in ((twice, asked), (docs, two)):
        assert sorted(of(d, a).collect()) == sorted(of(d, a, False).collect())


def test_f6_q20_names_are_compared_by_their_text(spark):
    """The text of a name holds its words; pairs of terms are put together once a query."""
    docs = cut(spark.createDataFrame([(1, "n/2024-01-02-red-kite-map.md", "Red Kite Map", "red kite map"), (2, "n/x.md", "--", "red kite")], "doc_id bigint, source_path string, title string, text string"))
    asked = cut(spark.createDataFrame([(1, "kite map tour"), (2, "map kite"), (3, "the red kite map")], "query_id bigint, query_text string"))
    f = retrieval.Index.for_queries(chunking.sections(docs), asked).featured(asked)
    assert {(r.query_id, r.chunk_id >> 24): round(r.entity, 6) for r in f.collect()} == {(1, 1): 0.866667, (1, 2): 0.0, (2, 1): 1.0, (2, 2): 0.0, (3, 1): 1.0, (3, 2): 0.0}
    plan = f.select("entity")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan.split("MapInArrow")[0]


def test_f19_q13_the_share_of_words_comes_from_the_blocks(corpus):
    docs, asked = corpus
    f = retrieval.Index.for_queries(chunking.sections(docs), asked).featured(asked).select("query_id", "chunk_id", "exactness")
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "word_share" in plan and "array_intersect" not in plan and "n_path" not in plan
    assert {round(r.exactness, 6) for r in f.collect()} <= {0.0, 0.333333, 0.666667, 1.0}
