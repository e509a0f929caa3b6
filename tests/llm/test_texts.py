import datetime as dt
import random

import pytest

from corpusloom.llm import conversations as C
from corpusloom.llm import markup, scans

PLAIN = ["Set {alpha, beta} stays fixed.", "This was #3 on the agenda.", "Returns a Map<Key, Value> of hits.", "It took 5 * 3 * 2 hours.", "We are 10 & 12 of 30.", "Use snake_case_name and other_name here.", "The Q&A and the R&D sync moved.",
         "Call rank(a, b) -> c again.", "Keep a < b and c > d in mind.", "Costs ran from $40 to $60 overall.", "The range [3, 9] is enough.", "Growth was 2^10 at most.", "Stored under C:\\temp\\reports today.", "Run it as `best effort', they wrote.", "About ~20 minutes, or 50% more.",
         "- one\n- two", "1. one\n2. two", "", "  \n "]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_have_no_markup_and_stay(text):
    got, langs = markup.clean(text)
    assert langs == [] and got == text.strip()


@pytest.mark.parametrize("text,langs,clean", [
    ("# Head\n\nA **bold** [link](http://x.y/z) and `code`.", ["markdown"], "# Head\n\nA bold link and code."),
    ("Title\n=====\n\ntext", ["markdown"], "# Title\n\ntext"),
    ("<p class='a'>One<br/>two</p><ul><li>x</li></ul>", ["html"], "One\ntwo\n\n- x"),
    ("A &amp; B &mdash; &lt;c&gt;", ["html"], "A & B — <c>"),
    ("<script>var k=1;</script>text", ["html"], "text"),
    ("<div\n style='x'\n>One</div>", ["html"], "One"),
    ("== Head ==\n'''b''' and [[Page#x|shown]]", ["wiki"], "## Head\n\nb and shown"),
    ("{{infobox|name=N|rank=6}}\ntext", ["wiki"], "name: N; rank: 6\ntext"),
    ("\\section{Head}\n\\begin{itemize}\n\\item one\n\\end{itemize}", ["latex"], "# Head\n\n- one"),
    ("so $x^2$ holds", ["latex"], "so $x^2$ holds"),
    ("```html\n<ul><li>a</li></ul>\n```\nend", ["markdown"], "```\n<ul><li>a</li></ul>\n```\n\nend"),
    ("<pre><code># no **bold** [[x]]\n</code></pre>", ["html"], "```\n# no **bold** [[x]]\n```"),
    ("\\begin{verbatim}\n# <b>raw</b> **x**\n\\end{verbatim}", ["latex"], "```\n# <b>raw</b> **x**\n```"),
    ("**b** and [[x]]", ["markdown", "wiki"], "b and x"),
])
def test_markup(text, langs, clean):
    assert markup.clean(text) == (clean, langs)
    assert markup.clean(text.replace("\n", "\r\n"))[1] == langs


def test_hostile_texts_end_soon():
    for t in ("<pre>" * 20000, "```\n" * 20001, "$" * 30000, "[[" * 20000, "<" * 30000, "\\begin{verbatim}" * 5000, "**" * 20000, "{{" * 20000, "&lt;" * 20000, "\\[" * 20000):
        assert markup.clean(t)[0] is not None


def test_regions_drop_navigation_only():
    nav = "<nav>" + "".join(f"<a href='#{k}'>l{k}</a>" for k in range(12)) + "</nav>"
    page = f"<html><body>\n{nav}\n<p>{'A long paragraph of words. ' * 20}</p>\n<p>{'Another one follows here. ' * 20}</p>\n</body></html>"
    text, _ = markup.clean(page)
    assert "l3" not in text and "A long paragraph" in text and "Another one" in text


def test_cleaned_rows(spark):
    df = spark.createDataFrame([(1, "# H\n\nx", "c"), (2, None, "c"), (2, None, "c"), (None, "", "c")], "k long, t string, clean_text string")
    got = {(r.k, r.clean_text, tuple(r.markup)) for r in markup.cleaned(df, "k", "t").collect()}
    assert got == {(1, "# H\n\nx", ("markdown",)), (2, None, ()), (None, "", ())} and markup.cleaned(df, "k", "t").count() == 4


WORDS = "every careful reader notices another printed mistake inside this lengthy volume about gardens and rivers because nobody corrected those pages".split()


def scan(r, header=None, number=None, hyphen=False, pages=4):
    """Wrapped text of some pages, with what is asked for, and the paragraphs as they were."""
    lines, paragraphs = [], []
    for _ in range(pages * 3):
        ws = [r.choice(WORDS) for _ in range(r.randint(30, 60))]
        ws[0] = ws[0].capitalize()
        paragraphs.append(" ".join(ws) + ".")
        line = ""
        for w in (paragraphs[-1]).split(" "):
            if len(line) + len(w) + 1 > 60:
                if hyphen and len(w) > 6 and r.random() < 0.5:
                    lines.append((line + " " + w[:4] + "-").strip())
                    w = w[4:]
                else:
                    lines.append(line)
                line = w
            else:
                line = (line + " " + w).strip()
        lines += [line, ""]
    size = len(lines) // pages
    out = []
    for p in range(pages):
        part = lines[p * size : (p + 1) * size if p < pages - 1 else None]
        out += ([header] if header else []) + part + ([number.format(p + 7)] if number else []) + ([""] if header or number else [])
    return "\n".join(out), paragraphs


@pytest.mark.parametrize("header,number,hyphen", [(None, None, False), ("The Lengthy Volume", None, False), (None, "- {} -", False), ("A RUNNING HEAD", "{}", True), (None, None, True), (None, "Page {} of 11", True)])
def test_scans(header, number, hyphen):
    want = {k for k, v in (("header", header), ("page_number", number), ("hyphen", hyphen)) if v}
    model = scans.Model(scans.beliefs())
    for seed in range(8):
        text, paragraphs = scan(random.Random(seed), header, number, hyphen)
        got, noise, _ = scans.repair(text, model)
        assert set(noise) == want
        assert " ".join(got.split()) == " ".join(" ".join(paragraphs).split())


def test_things_that_only_resemble_noise():
    text, _ = scan(random.Random(9))
    body = text.split("\n\n")
    decoys = ["Rows 43-\n52 stay open.", "2255", "Open points", "Read- and write-heavy notes, 2025-\n2026 only.", "As follows -", "Open points", "Total 412", "Total 412"]
    mixed = "\n\n".join(x for pair in zip(body, decoys + [""] * len(body)) for x in pair if x)
    assert scans.repair(mixed, scans.Model(scans.beliefs()))[1] == []


def test_misread_words_and_nulls(spark):
    good = "the careful reader corrected another lengthy volume (utf8, K8s, 0x1F)"
    rows = [(k, good) for k in range(40)] + [(100, "the carefu| reader corrected ariother lengtby v0lume"), (101, "a con\ufb01rmed \ufb01nding"), (102, None), (103, " "), (103, " "), (None, "the carefu| reader")]
    df = spark.createDataFrame(rows, "k long, t string")
    tx, wrong = scans.repaired(df, "k", "t")
    noise = {tuple(r) for r in scans.noise(tx, wrong, "k").collect()}
    assert noise == {(100, "misread"), (101, "misread")}
    fixed = {r.k: r.text for r in scans.corrected(tx, wrong, "k").collect()}
    assert fixed[100] == "the careful reader corrected another lengthy volume" and fixed[101] == "a confirmed finding" and fixed[102] is None and fixed[103] == ""
    empty = scans.repaired(df.limit(0), "k", "t")
    assert scans.noise(*empty, "k").count() == 0


LINES = "session_id string, rollout_path string, line_no int, type string, timestamp string, payload struct<id: string, cwd: string, type: string, role: string, content: array<struct<type: string, text: string>>>, ingested_at timestamp, agent string"


def brute(rows):
    files, talk = {}, {}
    for s, f, n, kind, ts, p, got, _ in rows:
        if s is None:
            continue
        f = f or ""
        at = None if ts is None else dt.datetime.fromtimestamp(int(ts) / 1000, dt.timezone.utc) if ts.isdigit() else dt.datetime.fromisoformat(ts.replace("Z", "+00:00"))
        d = files.setdefault((s, f), {"lines": {}, "at": []})
        if at:
            d["at"].append(at)
        shown = kind == "response_item" and p and p[2] == "message" and any((c[1] or "").replace("\u200b", "").strip() for c in p[4] or [])
        role = ((p[3] or "").strip().lower() if p else "")
        d["lines"][n] = "u" if shown and role in C.USER else "a" if shown and role in C.ASSISTANT else ""
    bad = set()
    for s in {k[0] for k in files}:
        own = sorted((min(d["at"]), f, d["lines"]) for (x, f), d in files.items() if x == s)
        turns = "".join(ls[n] for _, _, ls in own for n in sorted(ls))
        holes = any(sorted(ls) != list(range(1, len(ls) + 1)) for _, _, ls in own)
        if not turns or turns[0] != "u" or "uu" in turns or turns[-1] == "u" or holes:
            bad.add(s)
        talk[s] = turns
    return bad, talk


def test_conversations_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for s in range(60):
        clock = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=r.randrange(90))
        files_ = [f"f{s}-{k}" for k in range(r.choice([1, 1, 2, 3]))]
        r.shuffle(files_)
        for f in files_:
            clock += dt.timedelta(hours=5)
            n = 0
            for _ in range(r.randrange(4) if s % 9 == 0 else r.randrange(1, 5)):
                for role, text in (("User", "q"), ("model", "answer")):
                    n += 1
                    clock += dt.timedelta(seconds=3)
                    ts = clock.isoformat().replace("+00:00", "Z") if n % 2 else str(int(clock.timestamp() * 1000))
                    if r.random() < 0.04:
                        continue
                    body = [("text", text)] if r.random() > 0.03 else [("text", " \u200b")]
                    row = (f"s{s}", f, n, "response_item", ts if r.random() > 0.05 or n == 1 else None, (None, None, "message", role, body), clock, "clash")
                    rows += [row] * r.choice([1, 1, 1, 2])
    long_ = [("hot", "big", n, "response_item", str(1_770_000_000_000 + n), (None, None, "message", "user" if n % 2 else "agent", [("text", "x")]), dt.datetime(2026, 5, 1), "") for n in range(1, 2601)]
    rows += long_ + [("e", "e", 1, "session_meta", "2026-01-01T00:00:00Z", None, None, ""), (None, "x", 1, "y", None, None, None, "")]
    have = [x for x in rows if x[0] is None or any(y[0] == x[0] and y[1] == x[1] and y[4] for y in rows)]
    r.shuffle(have)
    for part in range(3):
        spark.createDataFrame(have[part::3], LINES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
    lines = C.codex_lines(spark.read.parquet(f"{tmp_path}/lines"), True)
    bad, talk = brute(have)
    seen = []
    segments = C.replayed(lines, progress=seen)
    got = C.verdicts(segments).collect()
    assert {x.session_id for x in got} == set(talk) and {x.session_id for x in got if x.broken} == bad and 0 < len(bad) < len(talk) and "hot" not in bad
    assert len(seen) >= 3 and seen[0][1] > len(talk) and max(held for held, _ in seen) < len(talk) / 4  # closed on the way, not at the end
    told = {}
    for m in sorted(C.messages(segments, lines).collect(), key=lambda m: (m.session_id, m.seq)):
        assert m.seq == len(told.setdefault(m.session_id, "")) and m.text
        told[m.session_id] += "u" if m.role == "user" else "a"
    assert told == {s: t for s, t in talk.items() if s not in bad}


def test_lines_that_come_late_and_twice(spark):
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    row = lambda s, n, role, text, day: (s, "f", n, "response_item", str(1_770_000_000_000 + n), (None, None, "message", role, [("text", text), ("text", None)]), at(day), "x")
    rows = [row("a", 1, "user", "q", 0), row("a", 3, "user", "q2", 1), row("a", 4, "agent", "r2", 1), row("a", 2, "Model", "r1", 60), row("a", 2, "Model", "r1", 70), row("b", 1, "human", "q", 5)]
    lines = C.codex_lines(spark.createDataFrame(rows, LINES), True)
    segments = C.replayed(lines, "2 days")
    assert [(m.seq, m.role, m.text) for m in C.messages(segments, lines).orderBy("seq").collect()] == [(0, "user", "q"), (1, "assistant", "r1"), (2, "user", "q2"), (3, "assistant", "r2")]
    assert {r.session_id for r in C.verdicts(segments).filter("unanswered").collect()} == {"b"}


def test_no_lines(spark):
    lines = C.codex_lines(spark.createDataFrame([], LINES), True)
    segments = C.replayed(lines)
    assert C.verdicts(segments).count() == 0 and C.messages(segments, lines).count() == 0
