"""From ranked documents to answers, what classes documents are of, and how well a ranking does."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import pairs
from corpusloom.operators.skew import split_cumulate
from corpusloom.session import cut

# Words in a document's path or titles that tell its class, in the order in which they are tried.
CLASSES = {
    "guide": "guide protocol fundamentals strategy playbook template blueprint".split(),
    "summary": "summary overview digest intel weekly launch recap".split(),
    "review": ["review", "retro", "checkin", "check-in", "evening review"],
    "research": "research inspiration insights analysis study article".split(),
    "project_note": "gtm notion supabase campaign growth auth".split(),
}
EPISODIC = "daily review report council log journal notes".split()
AGGREGATE = "summary overview digest intel weekly launch recap review".split()
# Query terms that ask for a class.
ASKS = {
    "review": "review evening retro".split(), "research": "research insights analysis article future study".split(), "summary": "summary overview weekly".split(),
    "project_note": "tracking migrado campaign launch supabase".split(),
}


def _has(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def memory_class(profile: Column, dated: Column, ruled: Column | None = None) -> Column:
    """The class that a rule gives, else by the words of the lower-case profile, else daily_note if dated, else other."""
    out = F.when(dated, "daily_note").otherwise("other")
    for name, words in reversed(CLASSES.items()):
        out = F.when(_has(profile, words), name).otherwise(out)
    return F.coalesce(ruled, out) if ruled is not None else out


def rule_class(rules: list[dict], path: Column, title: Column, tags: Column, content: Column) -> Column:
    """The class of the rule of highest priority (ties: the first) of which any needle is in its field; null if none matches."""
    fields = {"path_contains": path, "title_contains": title, "content_contains": content}
    out = F.lit(None).cast("string")
    for r in [r for _, r in sorted(enumerate(rules), key=lambda x: (x[1].get("priority", 0), -x[0]))]:
        hit = F.lit(False)
        for name, c in fields.items():
            for needle in r.get(name, ()):
                hit = hit | F.coalesce(F.contains(c, T.fold(F.lit(needle))), F.lit(False))
        for needle in r.get("tag_contains", ()):
            hit = hit | F.coalesce(F.array_contains(tags, T.fold(F.lit(needle))), F.lit(False))
        out = F.when(hit, r["class"]).otherwise(out)
    return out


def profile_features(profile: Column, dated: Column) -> dict[str, Column]:
    aggregate = _has(profile, AGGREGATE)
    return {"episodic": F.least(F.when(dated, 0.7).otherwise(0.0) + F.when(_has(profile, EPISODIC), 0.3).otherwise(0.0), F.lit(1.0)), "aggregate": F.when(aggregate, 1.0).otherwise(0.0),
            "session_note": F.when(dated & ~aggregate, 1.0).otherwise(0.0), "evergreen": F.when(_has(profile, CLASSES["guide"]), 1.0).otherwise(0.0)}


def class_bias(terms: Column, recall: Column, cls: Column) -> Column:
    """What a document's class adds for a query with these terms."""
    asks = {k: F.arrays_overlap(terms, F.array(*[F.lit(x) for x in v])) for k, v in ASKS.items()}
    w = lambda *pairs: F.when(pairs[0][0], pairs[0][1]) if len(pairs) == 1 else w(*pairs[:-1]).when(pairs[-1][0], pairs[-1][1])
    by = {
        "daily_note": w((recall & ~asks["review"] & ~asks["research"], 0.10)), "review": w((asks["review"], 0.14), (recall, 0.02)), "research": w((asks["research"], 0.14), (recall, -0.08)),
        "summary": w((asks["summary"], 0.10), (recall, -0.10)), "guide": w((recall, -0.12)), "project_note": w((asks["project_note"], 0.10), (recall & ~asks["research"], 0.06)),
    }
    out = F.lit(0.0)
    for k, v in by.items():
        out = F.when(cls == k, v.otherwise(0.0)).otherwise(out)
    return out


def freshness(mode: Column, lexical: Column, coverage: Column, ordinal: Column, latest: Column) -> Column:
    share = 1 / (1 + F.greatest(latest - ordinal, F.lit(0)) / 7)
    weight = F.when(mode == "lookup", 0.03).when(mode == "recall", 0.12).otherwise(0.04)
    return F.when(ordinal.isNotNull() & latest.isNotNull() & ((lexical >= 0.45) | (coverage >= 0.50)), share * weight).otherwise(0.0)


def temporal_match(asked: Column, own: Column) -> Column:
    """1 for the same date, .8 if the query gives no year, else 0; both as T.date_parts()."""
    same = (asked["month"] == own["month"]) & (asked["day"] == own["day"]) & own["year"].isNotNull()
    return F.coalesce(F.when(same & asked["year"].isNull(), 0.8).when(same & (asked["year"] == own["year"]), 1.0), F.lit(0.0))


def concepts(evidence: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, term, score, rank) over evidence (query_id, query_text, source_path, text, score, rank): the terms of the first five
    texts that are not the query's, by the sum of the texts' scores and .15 a source; ties by term."""
    e = evidence.filter("rank <= 5").select("query_id", "source_path", "score", F.explode(F.array_except(T.generator_terms(F.col("text")), T.generator_terms(F.col("query_text")))).alias("term"))
    s = e.groupBy("query_id", "term").agg((F.sum("score") + 0.15 * F.count_distinct("source_path")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(-F.round("score", 9), "term")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def sentences(text: Column) -> Column:
    """Sentences of a text: lines, cut after . ! ? before white space but not inside a decimal; rows of tables as they stand."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^\|[\s|:-]*\|$"))
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.when(x.startswith("|"), F.array(x)).otherwise(F.split(x, r"(?<=[.!?])\s+")))), lambda s: F.trim(s)), lambda s: s != "")


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def selected_sentences(evidence: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, place, source_path, sentence): a diverse choice from the first texts, one after the other.

    A sentence scores by query and concept terms, its text's score and rank; a chosen one lowers what repeats it. At equal scores the
    earlier wins. A query's evidence is a few texts, so one task holds it.
    """
    c = concepts(evidence).groupBy("query_id").agg(F.collect_set("term").alias("concepts"))
    rows = evidence.filter("rank <= 5").join(c, "query_id", "left").select("query_id", "rank", "source_path", "score", T.generator_terms(F.col("query_text")).alias("asked"), F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
                                                                          F.posexplode(sentences(F.col("text"))).alias("at", "s"))
    rows = rows.withColumn("sentence", T.clean_sentence(F.col("s"))).filter(F.octet_length("sentence") >= 24).withColumn("terms", F.array_distinct(T.generator_terms(F.col("sentence")))).filter(F.size("terms") > 0).withColumn("key", T.sentence_key(F.col("sentence"))).drop("s")

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "at"]).drop_duplicates("key")
        asked, known = set(pdf.asked.iloc[0]), set(pdf.concepts.iloc[0])
        left = []
        for r in pdf.itertuples():
            terms, n = set(r.terms), len(r.sentence.encode())
            left.append((2.4 * len(terms & asked) + 0.45 * len(terms & known) + 1.4 * r.score + 4 / r.rank - (min((n - 320) / 320, 1.0) if n > 320 else 0.0), terms, r.source_path, r.sentence))
        out, seen, used = [], set(), {}
        while left and len(out) < most:
            gain = [b + 3 * len((t & asked) - seen) + 0.7 * len((t & known) - seen) - 1.6 * max((_jaccard(t, o[1]) for o in out), default=0.0) - 0.1 * used.get(p, 0) for b, t, p, _ in left]
            best = max(range(len(left)), key=lambda k: (gain[k], -k))
            out.append(left.pop(best))
            seen |= out[-1][1]
            used[out[-1][2]] = used.get(out[-1][2], 0) + 1
        return pd.DataFrame({"query_id": [key[0]] * len(out), "place": range(len(out)), "source_path": [o[2] for o in out], "sentence": [o[3] for o in out]})

    kind = evidence.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, place int, source_path string, sentence string")


def fielded_baseline(docs: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 over title (3), path (1.5) and body (1), and 1.5 where the title has all terms; ties by path."""
    k1, b, weights = 1.2, 0.75, {"title": 3.0, "path": 1.5, "body": 1.0}
    d = docs.filter("trim(text) <> ''").select("doc_id", "source_path", T.tokens(F.coalesce("title", F.lit(""))).alias("title"), T.tokens(F.col("source_path")).alias("path"), T.tokens(F.col("text")).alias("body"))
    n, *average = d.agg(F.count(F.lit(1)), *[F.avg(F.size(f)) for f in weights]).first()
    long = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(w / 1.0).alias("w"), F.col(f).alias("ts"), (1 - b + b * F.size(f) / max(a or 0.0, 1.0)).alias("norm")) for (f, w), a in zip(weights.items(), average)])).alias("f"))
    q = cut(queries.select("query_id", F.array_distinct(F.filter(T.tokens(F.col("query_text")), lambda t: (F.octet_length(t) >= 2) & ~t.isin(T.STOP))).alias("terms")), "queries")
    qt = q.select("query_id", F.explode("terms").alias("token"))
    tf = long.select("doc_id", "f.w", "f.norm", F.explode("f.ts").alias("token")).join(qt.select("token").distinct(), "token", "left_semi").groupBy("doc_id", "token", "w", "norm").agg(F.count(F.lit(1)).alias("tf"))
    wf = cut(tf.groupBy("token", "doc_id").agg(F.sum(F.col("w") * F.col("tf") / F.col("norm")).alias("wf"), F.max(F.col("w") == weights["title"]).alias("titled")), "weights")
    df = wf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    part = wf.join(df, "token").select(F.col("doc_id").alias("key"), F.col("token").alias("term"), (F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("wf") * (k1 + 1) / (k1 + F.col("wf"))).alias("score"), "titled")
    said = part.select("key", F.lit(pairs.CONTENT).alias("kind"), "term", "score", F.lit(0.0).alias("idf")).unionByName(
        part.filter("titled").select("key", F.lit(pairs.METADATA).alias("kind"), "term", F.lit(0.0).alias("score"), F.lit(0.0).alias("idf")))
    asked = cut(q.filter(F.size("terms") > 0).select("query_id", F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"), F.lit(False).alias("numeric"))).alias("terms")), "asked")
    # A document's score for a query is made where its block meets the query; only what may be among the first top_k leaves it.
    best = pairs.best_scores(pairs.packed_rows(said, n), cut(pairs.packed_queries(asked, asked.count()), "asked-blocks"), n, top_k, queries.schema["query_id"].dataType, pairs.fielded, {"doc_id": "bigint", "score": "double"}, pairs.fielded_grades)
    scored = best.join(d.select("doc_id", "source_path"), "doc_id")
    w = Window.partitionBy("query_id").orderBy(-F.round("score", 9), "source_path", "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("query_id", "doc_id", "score", "rank")


def sampled_cases(docs: DataFrame, cases: int) -> DataFrame:
    """(query_id, query_text, doc_id): titles of documents sampled evenly over those with a title that no other has."""
    only = docs.filter("title is not null and trim(text) <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    k = split_cumulate(only.withColumn("one", F.lit(1).cast("long")), [], [F.col("doc_id")], "one", "at")
    n, c = max(only.count() - 1, 1), max(cases - 1, 1)
    # Case q is the document at floor(q n / c); at most one q stands at a place if there are more documents than cases.
    q = F.ceil(F.col("at") * c / n)
    return k.filter((F.floor(q * n / c) == F.col("at")) & (q < cases)).select(q.cast("bigint").alias("query_id"), F.col("title").alias("query_text"), "doc_id")


def retrieval_metrics(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """One row (cases, hits, hit_rate, mrr): where the expected document stands among the first k results."""
    r = cases.join(results.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return r.agg(F.count(F.lit(1)).alias("cases"), F.count("rank").alias("hits"), F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def nearest_rank(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """(quantile, value): the element at ceil((n - 1) q) of the sorted values, not interpolated."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = split_cumulate(rows, [], [F.col(value)], "n", "before")
    total = rows.agg(F.sum("n")).first()[0] or 0
    want = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.lit(math.ceil((total - 1) * q)).alias("at")) for q in quantiles])).alias("w")
    return upto.select("*", want).filter((F.col("w.at") >= F.col("before")) & (F.col("w.at") < F.col("before") + F.col("n"))).select("w.quantile", value)


# What is said where there is nothing to say, and how unsure answers begin.
NO_TERMS = "I could not match this query to any learned memory yet."
NO_RESULTS = "No relevant memories were found for this query."


def rendered_results(bundles: DataFrame, chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, source_path, rank, score, content, chunk_index): each ranked document's shown chunks (bundles: query_id, source_path, rank,
    chunk_id, place; six at most) put together and cleaned; score between 0 and 1; the number of the first chunk."""
    shown = bundles.join(chunks.select("chunk_id", "content", "chunk_index"), "chunk_id")
    g = shown.groupBy("query_id", "source_path", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "content", "chunk_index"))).alias("parts"))
    text = T.evidence_text(F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n"))
    clamp = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return g.join(ranked.select("query_id", "source_path", clamp.alias("score")), ["query_id", "source_path"]).select("query_id", "source_path", "rank", "score", text.alias("content"), F.get("parts", F.lit(0))["chunk_index"].alias("chunk_index"))


def simple_answers(evidence: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, answer): the first texts of each query, in order, as they stand."""
    e = evidence.filter(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("a"))
    return e.select("query_id", F.array_join(F.transform("a", lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("answer"))


def outlines(text: Column, most: int = 12) -> Column:
    """The headings of a text, cleaned, each once, most of them at most."""
    heads = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    named = F.filter(F.transform(heads, lambda h: F.rtrim(F.regexp_replace(T.clean_sentence(h), r"\.+$", ""))), lambda h: F.octet_length(h) >= 4)
    first = F.filter(F.transform(named, lambda h, i: F.struct(h.alias("h"), (F.array_position(F.transform(named, T.sentence_key), T.sentence_key(h)) == i + 1).alias("new"))), lambda x: x["new"])
    return F.slice(F.transform(first, lambda x: x["h"]), 1, most)



def answer_texts(queries: DataFrame, results: DataFrame, sentences: DataFrame, concept_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, answer, confidence): an answer for every query of the batch.

    results: (query_id, rank, confidence); sentences: (query_id, place, source_path, sentence); concept_rows: (query_id, term, rank); texts:
    (query_id, rank, text), of which the first gives the outline. Under .3 and .6 of confidence it begins with a caveat. A query without
    a term, or without a result, gets a fixed message and a confidence of 0.
    """
    said = sentences.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"), F.array_sort(F.collect_set(F.regexp_extract("source_path", r"([^/]*)$", 1))).alias("sources"))
    known = concept_rows.filter("rank <= 8").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("c"))
    top = results.filter("rank = 1").select("query_id", "confidence")
    heads = texts.filter("rank = 1").select("query_id", outlines(F.col("text")).alias("heads"))
    q = queries.join(top, "query_id", "left").join(said, "query_id", "left").join(known, "query_id", "left").join(heads, "query_id", "left")
    c = F.format_number("confidence", 2)
    lead = F.when(F.col("confidence") < 0.3, F.concat(F.lit("I have limited knowledge about this topic (confidence: "), c, F.lit("). From available evidence: "))).when(
        F.col("confidence") < 0.6, F.concat(F.lit("Based on available evidence (confidence: "), c, F.lit("), "))).otherwise("")
    part = lambda name, xs, sep: F.when(F.size(xs) > 0, F.concat(F.lit(f" [{name}: "), F.array_join(xs, sep), F.lit("]"))).otherwise("")
    none = F.array().cast("array<string>")
    text = F.concat(lead, F.array_join(F.coalesce(F.transform("s", lambda x: x["sentence"]), none), " "), part("Key concepts", F.coalesce(F.transform("c", lambda x: x["term"]), none), ", "), part("Sections", F.coalesce("heads", none), "; "), part("Sources", F.coalesce("sources", none), ", "))
    terms = F.size(T.exact_terms(F.coalesce("query_text", F.lit(""))))
    return q.select("query_id", F.when(terms == 0, NO_TERMS).when(F.col("confidence").isNull(), NO_RESULTS).otherwise(text).alias("answer"), F.when(terms == 0, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def project_link(name: Column, aliases: dict[str, str], prefix: str) -> Column:
    """The target of the first alias that is part of a project's name, else the name under the prefix; null without a name."""
    out = F.concat(F.lit(f"{prefix}/"), name)
    for alias, target in reversed(aliases.items()):
        out = F.when(F.contains(F.lower(name), F.lit(alias)), target).otherwise(out)
    return F.when(name.isNotNull() & (name != "") & (name != "unknown"), out)
