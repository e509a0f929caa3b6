import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing, splitting, tokenizer

enc = tokenizer.encoder()


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokenizer.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    from array import array
    return list(array("i", enc.encode_bytes(text)))


def test_against_the_library(library):
    r = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "<|endoftext|>", "日", "\u00a0", "\x1c", "\x85", "\u2003", "the", "  \n", "ing", "!", "\u200b", "=" * 70, "ation", "\r\n", "😀"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert ids(t) == library.encode_ordinary(t)
    for t in ("a" * 5000, "-" * 3000, "ab" * 2000 + " " * 500, "word\nword " * 500, ""):
        assert ids(t) == library.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    data = b"".join(enc.text[i].encode("latin-1") for i in ids(text))
    assert data == text.encode("utf-8", "replace")


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "x" * 20000)], "k long, t string")
    got = sorted(((r.k is not None, r.k), r.ids) for r in tokenizer.encoded(df, "k", "t").collect() if r.k is not None)
    assert [g[1] for g in got] == [ids("a b"), [], [], []] and tokenizer.encoded(df, "k", "t").count() == 5
    assert tokenizer.encoded(df.limit(0), "k", "t").count() == 0


def check_pieces(text, limit, overlap):
    p = splitting.pieces(enc, text, limit, overlap)
    assert "".join(text[own:stop] for _, own, stop, _ in p) == text
    for start, own, stop, n in p:
        assert start <= own <= stop and n == enc.count(text[start:stop]) <= limit
    for a, b in zip(p, p[1:]):
        assert a[1] <= b[0] and enc.count(text[b[0] : b[1]]) <= overlap
    assert (len(p) > 1) == (enc.count(text) > limit)
    return p


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "# Head\n", "\n\n", "A sentence here. ", "é", "日本語", "x" * 40, "```\ncode\n```\n", " ", "\r\n", "- item\n", "😀"]), max_size=120), st.integers(8, 40), st.integers(0, 3))
def test_pieces(parts, limit, overlap):
    check_pieces("".join(parts), limit, overlap)


def test_cuts_at_headings_and_overlaps():
    text = "".join(f"## Part {k}\n\n" + "Some words stand here in a row. " * 12 + "\n\n" for k in range(12))
    p = check_pieces(text, 200, 20)
    assert all(text[own:].startswith("## Part") for _, own, _, _ in p)
    assert all(b[0] < b[1] for b in p[1:])
    assert len(check_pieces("a" * 60000, 512, 16)) > 3
    check_pieces("w " * 40000, 512, 64)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "\n", "\n\n", " \n ", "é", "日本語", "x" * 40, "  ", "\r\n", "- item\n", "😀", "'s", "\u00a0", "12 "]), max_size=120), st.integers(1, 12))
def test_count_upto(parts, most):
    n = enc.count("".join(parts))
    assert enc.count_upto("".join(parts), most) == (n if n <= most else None)


def test_a_long_text_is_not_encoded_to_see_that_it_is_long(monkeypatch):
    seen, own = [], tokenizer.Encoder.count
    monkeypatch.setattr(tokenizer.Encoder, "count", lambda self, text: seen.append(len(text)) or own(self, text))
    assert enc.count_upto("word and\nline " * 50_000, 64) is None and sum(seen) < 2_000


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "word " * 200), (2, None), (3, ""), (3, "")], "k long, t string")
    got = splitting.split_texts(df, "k", "t", 64, 8).collect()
    assert sum(r.k == 3 for r in got) == 2 and [r.piece_text for r in got if r.k == 2] == [None] and max(r.piece for r in got) > 2
    assert splitting.split_texts(df.limit(0), "k", "t", 64, 8).count() == 0


def optimum(sizes, capacity):
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[k]:
                go(k + 1, rooms[:j] + [rooms[j] - sizes[k]] + rooms[j + 1 :])
        go(k + 1, rooms + [capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_completion_is_optimal_on_small_cases():
    r = random.Random(0)
    for _ in range(150):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 9))]
        bins = packing.complete(sizes, 100)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
        assert packing.least(sizes, 100) <= len(bins) == optimum(sizes, 100)


def test_completion_beats_best_fit():
    def sizes(seed):
        r = random.Random(seed)
        return [r.randint(60, 400) for _ in range(r.randint(18, 30))]

    assert len(packing.best_fit(sizes(19), 1000)) == 7 and [len(packing.completed(sizes(19), 1000)[0]), packing.completed(sizes(19), 1000)[1]] == [6, True]
    won = [len(packing.best_fit(s, 1000)) - len(packing.complete(s, 1000)) for s in map(sizes, range(100))]
    assert min(won) == 0 and sum(won) >= 5


def test_fillings_are_whole_and_fullest_first():
    r = random.Random(3)
    for _ in range(60):
        counts = {s: r.randint(1, 2) for s in r.sample(range(1, 30), r.randint(1, 6))}
        up, room = sorted(counts), r.randint(5, 60)
        got = list(packing._fillings(up, counts, room))
        items = [s for s in up for _ in range(counts[s])]
        subsets = {tuple(sorted((items[k] for k in range(len(items)) if m >> k & 1), reverse=True)) for m in range(1 << len(items))}
        fit = {f for f in subsets if sum(f) <= room}
        assert set(got) <= fit and [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        # What is left out is dominated by one that is there: each of its items, or several together, by an item that is larger.
        assert all(f in got or any(sum(g) >= sum(f) for g in got) for f in fit)


def test_block_report(spark):
    df = spark.createDataFrame([(k, "word " * (20 + 7 * k % 60)) for k in range(90)] + [(None, None)], "k long, t string")
    rows = packing.block_report(df.coalesce(1), "k", "t", 128, block=30).collect()
    assert sum(r.items for r in rows) == 90 and all(r.least <= r.containers <= r.best_fit and (r.proved or r.containers > r.least) for r in rows)
    assert packing.block_report(df.limit(0), "k", "t", 128).count() == 0


def test_packed_rows(spark):
    df = spark.createDataFrame([(k, "word " * (k % 90)) for k in range(300)] + [(900, None), (901, ""), (902, "word " * 1000)], "k long, t string")
    got = packing.packed(df.coalesce(1), "k", "t", 128, block=100).collect()
    used = {}
    for r in got:
        used.setdefault(r.container, []).append((r.place, r.n_tokens))
    for items in used.values():
        at = 0
        for place, n in sorted(i for i in items if i[1]):
            assert place == at
            at += n
        assert at <= 128
    assert {r.k for r in got} == {*range(300), 900, 901, 902}
    assert sum(r.n_tokens for r in got if r.k == 50) == enc.count("word " * 50) and sum(r.k == 902 for r in got) > 1
    full = sum(n for i in used.values() for _, n in i) / (128 * len(used))
    assert full > 0.9
    assert packing.packed(df.limit(0), "k", "t", 128).count() == 0
