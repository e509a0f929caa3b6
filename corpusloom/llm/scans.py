"""Text of scanned pages to continuous paragraphs: lines are labelled by a hidden Markov model, words by a lexicon of the corpus.

States are body, header (running headers and footers), page number and break. What a line shows of itself and of its place is a
handful of layout features, independent given the state; the model's tables start from stated beliefs and are fitted to all
texts by Viterbi training until they settle. Features are worked out once a text and kept as a byte a line. Paragraphs are put together from the body lines, words broken over line ends rejoined. A rare word
that becomes a far more frequent one of the corpus when a known confusion of characters is undone counts as misread.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

BODY, HEADER, PAGE, BREAK = range(4)
STATES = ("body", "header", "page_number", "break")
#: Features: what kind of line it is; whether its like recurs, at places that look like page ends or not; whether it interrupts a
#: sentence; whether it stands at a form feed or page number.
KINDS = ("blank", "bare", "styled", "mixed", "short", "long")
RECURS = ("no", "plain", "paged")
# Beliefs before any text is seen, as shares.
_START = {
    "first": [0.80, 0.10, 0.08, 0.02],
    "next": [[0.85, 0.012, 0.012, 0.126], [0.35, 0.01, 0.14, 0.50], [0.30, 0.28, 0.01, 0.41], [0.85, 0.06, 0.06, 0.03]],
    "kind": [[1e-6, 0.010, 0.002, 0.003, 0.085, 0.90], [1e-6, 0.001, 0.001, 0.14, 0.84, 0.018], [1e-6, 0.42, 0.57, 0.001, 0.005, 0.001], [1 - 5e-6] + [1e-6] * 5],
    "recurs": [[0.97, 0.0295, 0.0005], [0.006, 0.0005, 0.9935], [0.05, 0.01, 0.94], [0.98, 0.01, 0.01]],
    "breaks": [[0.9995, 0.0005], [0.45, 0.55], [0.45, 0.55], [0.99, 0.01]],
    "edge": [[0.85, 0.15], [0.5, 0.5], [0.5, 0.5], [0.9, 0.1]],
}
#: So many symbols are there; one for each combination of features.
CHAIN = 72
#: The fitted tables: the features are believed to be independent, but fitted together, as what recurs in a text is mostly short.
_SHAPE = {"first": (1, 4), "next": (4, 4), "seen": (4, CHAIN)}


def beliefs() -> dict[str, list]:
    seen = [[a * b * c * d for a in _START["kind"][k] for b in _START["recurs"][k] for c in _START["breaks"][k] for d in _START["edge"][k]] for k in range(4)]
    return {"first": _START["first"], "next": _START["next"], "seen": seen}


#: A row of beliefs weighs as much as this many lines (or texts), however many there are: with a corpus of any size the lines decide.
BELIEF = 500.0
#: Training ends when no share moves by more than this, or after so many rounds.
SETTLED, ROUNDS = 0.002, 12

# The confusions of characters in recognised text, as seen -> as meant.
CONFUSED = {
    "0": "o", "1": "li", "5": "s", "8": "b", "9": "gq", "6": "b", "|": "li", "@": "a", "!": "li", "$": "s", "3": "e", "4": "a", "2": "z", "7": "t", "rn": "m", "m": ("rn", "in"), "cl": "d", "ii": "u",
    "ri": "n", "vv": "w", "c": "eo", "e": "c", "b": "h", "h": "b", "l": "it", "i": "l", "u": "n", "n": "u", "f": "t", "t": "f", "a": "o", "o": "ac", "li": "h", "lm": ("im",), "d": ("cl",), "w": ("vv",), "q": "g", "g": "q", "y": "v", "v": "y",
}
SOLID = set("0123456789|@!$")  # no letters, so a word with one of them inside needs less proof

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑­¬][ \t]*$")
_BARE = re.compile(r"\d{1,5}")
_STYLED = re.compile(r"(?:[-–—]\s*(\d{1,5})\s*[-–—])|\[\s*(\d{1,5})\s*\]|\(\s*(\d{1,5})\s*\)|(?:p(?:age|ag|ág|g)?|s(?:eite)?|página|pagina|seite)\.?\s*(\d{1,5})(?:\s*(?:of|de|von|/|sur)\s*\d{1,5})?", re.I)
_MIXED = (re.compile(r"(\d{1,5})\s{2,}(\S.*)"), re.compile(r"(.*\S)\s{2,}(\d{1,5})"))
_ENDS = re.compile(r"[.!?…:;。！？][\"'”’)\]]*$")
_TITLE = re.compile(r"[^\W_][^<>\\{}=`~#*_\[\]]*|[@|!$][^<>\\{}=`~#*_\[\]]+")
_LOWER = re.compile(r"[\s\"'“‘(\[]*[^\W\d_]")
_SKELETON = [("rn", "m"), ("in", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n")]
_SAME = str.maketrans("0158@|!$ceobhi9qg6uftvy3l", "olsbalisccohhlggghnttvvcl")


def _skeleton(s: str) -> str:
    """Alike for texts that confusions of characters turn into each other."""
    s = unicodedata.normalize("NFKC", s).casefold()
    for a, b in _SKELETON:
        s = s.replace(a, b)
    s = s.translate(_SAME)
    for a, b in _SKELETON + [("ll", "u"), ("rl", "n"), ("ln", "m"), ("m", "nn"), ("u", "n"), ("o", "c"), ("a", "c")]:
        s = s.replace(a, b)
    return re.sub(r"\W+", " ", s).strip()


def _number(s: str) -> tuple[str, int, str] | None:
    """(style, number, other text) of a line that is or holds a page number."""
    if _BARE.fullmatch(s):
        return "bare", int(s), ""
    if m := _STYLED.fullmatch(s):
        n = next(g for g in m.groups() if g)
        return re.sub(r"\d+", "9", s).replace(" ", "").lower()[:6], int(n), ""
    if m := _MIXED[0].fullmatch(s):
        return "mixed", int(m[1]), m[2]
    if m := _MIXED[1].fullmatch(s):
        return "mixed", int(m[2]), m[1]
    return None


def _chains(numbers: list[tuple[int, str, int]]) -> set[int]:
    """The lines of the longest run of each style whose numbers go up by one (or two, where one was missed), if of two or more."""
    best: dict[tuple[str, int], tuple[int, int, int]] = {}
    back: dict[int, int] = {}
    top: dict[str, tuple[int, int]] = {}
    for line, style, n in numbers:
        size, prev = max(((best[k][0], best[k][1]) for d in (1, 2) if (k := (style, n - d)) in best), default=(0, -1))
        if prev >= 0:
            back[line] = prev
        if (style, n) not in best or best[style, n][0] <= size + 1:
            best[style, n] = (size + 1, line, n)
        if size + 1 > top.get(style, (0, 0))[0]:
            top[style] = (size + 1, line)
    out: set[int] = set()
    for size, line in top.values():
        if size >= 2:
            out.add(line)
            while line in back:
                out.add(line := back[line])
    return out


class Lines:
    """The lines of a text, as they stand and without the space around them."""

    def __init__(self, text: str):
        raw: list[tuple[str, bool]] = []
        for k, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\f")):
            raw += [(x, k > 0 and j == 0) for j, x in enumerate(part.split("\n"))]
        # A form feed at a line end leaves an empty line, which is no break of its own.
        self.lines, self.feed = [x for x, _ in raw], [f for _, f in raw]
        self.bare = [x if x.isascii() else unicodedata.normalize("NFC", x) for x in map(str.strip, self.lines)]
        sizes = sorted(len(x) for x in self.bare if x)
        self.width = sizes[int(0.9 * (len(sizes) - 1))] if sizes else 0


class Page(Lines):
    """Lines with their features."""

    def __init__(self, text: str):
        super().__init__(text)
        bare, n = self.bare, len(self.bare)
        filled = [k for k in range(n) if bare[k]]
        self.after = dict(zip(filled, filled[1:]))
        self.before = dict(zip(filled[1:], filled))
        self.number = {k: x for k in filled if (x := _number(bare[k]))}
        self.chain = _chains([(k, s, v) for k, (s, v, _) in self.number.items()])
        short = {k for k in filled if len(bare[k]) <= max(0.8 * self.width, 12) and not _ENDS.search(bare[k]) and not re.search(r"[-,|‐­¬]$|[.?!,] ", bare[k])
                 and _TITLE.fullmatch(bare[k]) and sum(c.isalpha() for c in bare[k]) >= 4}
        mixed = {k for k, (s, _, _) in self.number.items() if s == "mixed"}
        self.kind = [0] * n
        for k in filled:
            style = self.number[k][0] if k in self.number else None
            self.kind[k] = 3 if k in mixed else 1 if style == "bare" else 2 if style else 4 if k in short else 5
        touches_feed = {k for k in filled if self._fed(k)}
        paged = {k for k in self.chain}
        self.edge = [False] * n
        for k in filled:
            self.edge[k] = k in touches_feed or k - 1 in paged or k + 1 in paged
        like: dict[str, list[int]] = {}
        for x in filled:
            if self.kind[x] in (3, 4):
                body = self.number[x][2] if x in mixed else bare[x]
                if sum(c.isalpha() for c in body) >= 4:
                    like.setdefault(_skeleton(body), []).append(x)
        self.again = {x for same in like.values() if len(same) >= 2 for x in same}
        self.breaks = [False] * n
        spare = {k for k in filled if self.kind[k] in (1, 2, 3, 4)}
        k = 0
        while k < len(filled):
            if filled[k] not in spare:
                k += 1
                continue
            j = k
            while j < len(filled) and filled[j] in spare:
                j += 1
            # Any stretch of the run may be the interruption: lines before it and after it may be body.
            for a in range(k, j):
                for b in range(a, min(j, a + 3)):
                    self._mark(filled[a : b + 1])
            k = j
        self.recurs = [0] * n
        for same in like.values():
            if len(same) >= 2:
                # Standing at an edge may be chance; interrupting a sentence, opening the text or counting pages is none, nor is it
                # for a line of three words to come a third time.
                proof = sum(self.breaks[x] or x == filled[0] or x in self.chain for x in same)
                for x in same:
                    self.recurs[x] = 2 if proof or len(bare[x].split()) >= 3 and (len(same) >= 3 or sum(self.edge[x] for x in same) > 0.7 * len(same)) else 1
        for x in self.chain:
            self.recurs[x] = 2

    def _fed(self, k: int) -> bool:
        """A form feed stands right before or after line k, at most an empty line between."""
        n = len(self.lines)
        if self.feed[k] or k and not self.bare[k - 1] and self.feed[k - 1] or k + 1 < n and self.feed[k + 1]:
            return True
        return k + 2 < n and not self.bare[k + 1] and self.feed[k + 2]

    def _mark(self, run: list[int]) -> None:
        a, b = self.before.get(run[0]), self.after.get(run[-1])
        if a is None or b is None:
            return
        x, y = self.bare[a], self.bare[b]
        if _ENDS.search(x) or not ((m := _LOWER.match(y)) and m[0][-1].islower()):
            return
        if self.kind[a] != 5 and (a == 0 or not self.bare[a - 1] or _ENDS.search(self.bare[a - 1])):
            return  # what stands alone above is no unfinished sentence
        if all(self.bare[k][:1].islower() for k in run):
            return
        apart = any(not self.bare[k] or self.feed[k] for k in range(a + 1, b)) or any(self.feed[k] for k in range(a + 1, b + 1)) or any(k in self.chain or k in self.again for k in run)
        if apart:
            for k in run:
                if not self.bare[k][:1].islower():
                    self.breaks[k] = True

    def symbols(self) -> bytes:
        """A byte a line: its features, and CHAIN more for one that counts pages."""
        return bytes(12 * kind + 4 * recurs + 2 * breaks + edge + CHAIN * (k in self.chain)
                     for k, (kind, recurs, breaks, edge) in enumerate(zip(self.kind, self.recurs, self.breaks, self.edge)))


class Model:
    def __init__(self, tables: dict[str, list]):
        log = {k: np.log(np.maximum(np.array(v, dtype=float), 1e-12)) for k, v in tables.items()}
        self.first, self.next, self.seen = log["first"].reshape(4), log["next"], log["seen"].T.copy()

    def labels(self, texts: list[bytes], cells: int = 1_000_000) -> list[bytes]:
        """The likeliest states of the lines of each text (Viterbi), many texts of like length at a time."""
        out: list[bytes] = [b""] * len(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            size = len(texts[order[at]])
            some = [k for k in order[at : at + max(1, cells // size)] if len(texts[k]) <= max(1.25 * size, size + 8)]
            at += len(some)
            for k, states in zip(some, self._viterbi([texts[k] for k in some])):
                out[k] = states
        return out

    def _viterbi(self, texts: list[bytes]) -> list[bytes]:
        n, most = len(texts), max(map(len, texts))
        codes = np.full((most, n), -1, np.int16)
        for k, t in enumerate(texts):
            codes[: len(t), k] = np.frombuffer(t, np.uint8) % CHAIN
        score, back = self.first + self.seen[codes[0]], np.empty((most, n, 4), np.int8)
        for t in range(1, most):
            ways = score[:, :, None] + self.next
            best = ways.argmax(axis=1)
            new = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0, :] + self.seen[codes[t]]
            on = (codes[t] >= 0)[:, None]
            # Beyond a text's end the states stand still.
            back[t], score = np.where(on, best, np.arange(4)), np.where(on, new, score)
        state, rows = score.argmax(axis=1), np.arange(n)
        states = np.empty((most, n), np.uint8)
        for t in range(most - 1, -1, -1):
            states[t] = state
            if t:
                state = back[t, rows, state]
        return [states[: len(t), k].tobytes() for k, t in enumerate(texts)]

    def label(self, symbols: bytes) -> bytes:
        return self.labels([symbols])[0]


def tabled(sums: dict[tuple[str, int], float]) -> dict[str, list]:
    """The model's tables from counts, with the beliefs as BELIEF further lines of each row."""
    out, believed = {}, beliefs()
    for name, (a, b) in _SHAPE.items():
        n = np.array([sums.get((name, k), 0) for k in range(a * b)], float).reshape(a, b) + BELIEF * np.array(believed[name], float).reshape(a, b)
        rows = (n / n.sum(axis=1, keepdims=True)).tolist()
        out[name] = rows[0] if name == "first" else rows
    return out


def fit(symbols: DataFrame, column: str, rounds: int = ROUNDS) -> dict[str, list]:
    """The model's tables after Viterbi training over the symbols of all texts; what comes to the driver is 308 sums a round."""
    tables = beliefs()
    for _ in range(rounds):
        def count(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            model, c = Model(tables), {n: np.zeros(a * b, np.int64) for n, (a, b) in _SHAPE.items()}
            for b in batches:
                texts = [t for t in b.column(0).to_pylist() if t]
                for sym, lab in zip(texts, model.labels(texts)):
                    x, y = np.frombuffer(sym, np.uint8) % CHAIN, np.frombuffer(lab, np.uint8).astype(np.int64)
                    c["first"][y[0]] += 1
                    c["next"] += np.bincount(4 * y[:-1] + y[1:], minlength=16)
                    c["seen"] += np.bincount(y * CHAIN + x, minlength=4 * CHAIN)
            names = [n for n in c for _ in c[n]]
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "at": pa.array([k for v in c.values() for k in range(len(v))], pa.int32()),
                                              "n": pa.array(np.concatenate(list(c.values())), pa.int64())})

        sums = {(r[0], r[1]): r[2] for r in symbols.select(column).mapInArrow(count, "name string, at int, n bigint").groupBy("name", "at").agg(F.sum("n")).collect()}
        new = tabled(sums)
        moved = max(float(np.abs(np.array(new[n]) - np.array(tables[n])).max()) for n in _SHAPE)
        tables = new
        if moved <= SETTLED:
            break
    return tables


_WRAPPED_AT = 120


def repair(text: str, model: Model) -> tuple[str, list[str], str]:
    """reassemble() of one text by a model."""
    symbols = Page(text).symbols()
    return reassemble(text, symbols, model.label(symbols))


def reassemble(text: str, symbols: bytes, lab: bytes) -> tuple[str, list[str], str]:
    """(paragraphs parted by blank lines, kinds of noise found but misread words, the headers taken out), by the states of the lines."""
    page = Lines(text)
    noise, out, gone = set(), [], []
    wrapped = 0 < page.width <= _WRAPPED_AT
    prev, gap = -1, False
    for k, state in enumerate(lab):
        line = page.bare[k]
        if state in (HEADER, PAGE) and line:
            number = _number(line)
            if state == HEADER or number and number[2]:
                noise.add("header")
                gone.append(number[2] if number else line)
            if state == PAGE or symbols[k] >= CHAIN:  # a header may hold the number too
                noise.add("page_number")
            continue
        if not line:
            gap = gap or not page.feed[k] or k + 1 < len(lab) and not page.bare[k + 1]
            continue
        indent = len(page.lines[k]) - len(page.lines[k].lstrip(" \t"))
        lower = bool((m := _LOWER.match(line)) and m[0][-1].islower())
        if not out:
            out.append(line)
        elif (h := _HYPHEN.search(out[-1])) and lower and not re.match(r"(?:and|or|und|y|e|o|ou|et)\b", line):
            noise.add("hyphen")
            out[-1] = out[-1][: h.start()] + line
        elif not wrapped:
            out.append(("\n\n" if gap else "\n") + line)
        elif gap and not (lower and not _ENDS.search(out[-1])) or not gap and indent >= 2 and not lower:
            out.append("\n\n" + line)
        elif not gap and _ENDS.search(out[-1]) and len(page.bare[prev]) < 0.7 * page.width and not lower:
            out.append("\n\n" + line)
        else:
            out.append(" " + line)
        prev, gap = k, False
    return "".join(out), sorted(noise), "\n".join(gone)


_WORD = r"[\p{L}\p{M}\p{N}|@!$]*\p{L}[\p{L}\p{M}\p{N}|@$]*"
_LIGATURE = "[ﬀ-ﬆ]"


#: By the confusions above: characters that stand for one stroke, and those made of several.
_STROKES = ("itf17|!reoa03@4yq95$2", "llllllllcccccccvggssz")
_PARTS = (("m", "lll"), ("n", "ll"), ("u", "ll"), ("h", "ll"), ("b", "ll"), ("8", "ll"), ("6", "ll"), ("d", "cl"), ("w", "vv"))


def _key(c: Column) -> Column:
    """Alike for words that confusions of characters turn into each other: each character is written as the strokes that it shares with others."""
    c = F.translate(c, *_STROKES)
    for a, b in _PARTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def undone(word: str, meant: str) -> bool:
    """Whether undoing two confusions of word gives meant, or one and any number of those of characters that are no letters."""
    n, m = len(word), len(meant)
    solid = bool(set(word) & SOLID)

    def go(i: int, j: int, left: int) -> bool:
        while i < n and j < m and word[i] == meant[j]:
            if left and any(to != word[i : i + k] and meant.startswith(to, j) and go(i + k, j + len(to), left - (k > 1 or word[i] not in SOLID))
                            for k in (1, 2) for to in CONFUSED.get(word[i : i + k], ())):
                return True
            i, j = i + 1, j + 1
        if i == n or j == m:
            return i == n and j == m
        for k in (1, 2):
            for to in CONFUSED.get(word[i : i + k], ()) if i + k <= n else ():
                cost = 0 if k == 1 and word[i] in SOLID else 1
                if cost <= left and meant.startswith(to, j) and go(i + k, j + len(to), left - cost):
                    return True
        return False

    return word != meant and go(0, 0, 1 if solid else 2)


def misread_words(words: DataFrame, least: int = 4, ratio: int = 8) -> DataFrame:
    """(word, meant) of the rare words of (doc, word) rows that are misread forms of frequent ones.

    A word of letters alone must be ratio times as rare as what it may have been; one with a digit or sign inside need only be
    rarer. What it may have been must be in least texts, or its own spelling is as doubtful. Frequencies are of texts, over all of
    them. Rare and frequent words meet on their strokes (_key), and only those that do are compared, whatever their length.
    """
    vocab = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "lexicon")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([undone(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    # What is in more texts than a ratio-th of the most frequent word cannot be rare beside any.
    most = vocab.agg(F.max("n")).first()[0] or 0
    signs = r"[0-9|@!$]"
    rare = vocab.filter((F.col("n") <= most / ratio) | F.col("word").rlike(signs)).filter(F.length("word") >= 3).select("word", "n", _key(F.col("word")).alias("strokes"))
    known = vocab.filter((F.col("n") >= least) & (F.length("word") >= 3) & ~F.col("word").rlike(signs)).select(F.col("word").alias("meant"), F.col("n").alias("known"), _key(F.col("word")).alias("strokes"))
    sure = (F.col("word").rlike(signs) & (F.col("known") > F.col("n"))) | (F.col("known") >= ratio * F.col("n"))
    pairs = rare.join(known, "strokes").filter(sure & (F.col("word") != F.col("meant"))).select("word", "meant", "known")
    right = pairs.mapInArrow(check, "word string, meant string, known bigint")
    return right.groupBy("word").agg(F.max(F.struct("known", "meant")).alias("m")).select("word", "m.meant")


def repaired(df: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, text, noise, headers) of each row, and (key, word, meant) of the misread words in each.

    text: the paragraphs, parted by blank lines, without headers, page numbers and broken words; misread words are still in it,
    see corrected(). noise: which of hyphen, header, page_number were found. Null text gives null and no noise, blank text the
    empty text. Rows stay as they are, repeated ones too; rows with a null key are left out of the second table.
    """
    kind = df.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else Page(t).symbols() for t in b.column(1).to_pylist()], pa.binary())], names=["k", "t", "s"])

    src = cut(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(look, f"k {kind}, t string, s binary"), "symbols")
    tables = fit(src, "s", rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(tables)
        for b in batches:
            syms = [x or b"" for x in b.column(2).to_pylist()]
            done = [(None, [], None) if x is None else reassemble(x, s, y) for x, s, y in zip(b.column(1).to_pylist(), syms, model.labels(syms))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string())), pa.array([d[2] for d in done], pa.string())], names=["k", "text", "noise", "headers"])

    texts = cut(src.mapInArrow(run, f"k {kind}, text string, noise array<string>, headers string"), "paragraphs")
    every = F.concat_ws("\n", "text", "headers")
    # Ligatures are misread characters by themselves; they are written out before words are looked up.
    words = texts.filter("k is not null").select("k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_plain(every)), F.lit(_WORD), F.lit(0)))).alias("word"))
    words = cut(words, "words")
    wrong = words.join(misread_words(words), "word").select("k", "word", "meant")
    tied = texts.filter("k is not null").select("k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(every), F.lit(rf"[\p{{L}}\p{{M}}]*{_LIGATURE}[\p{{L}}\p{{M}}ﬀ-ﬆ]*"), F.lit(0)))).alias("word"))
    both = wrong.unionByName(tied.select("k", "word", _plain(F.col("word")).alias("meant")))
    return texts.withColumnRenamed("k", key), both.withColumnRenamed("k", key)


def _plain(c):
    for a, b in zip("ﬀﬁﬂﬃﬄﬆ", ("ff", "fi", "fl", "ffi", "ffl", "st")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def noise(texts: DataFrame, wrong: DataFrame, key: str) -> DataFrame:
    """(key, noise): a row for each kind of noise in each text; rows of one key count as one."""
    kinds = texts.filter(F.col(key).isNotNull()).select(key, F.explode("noise").alias("noise"))
    return kinds.unionByName(wrong.select(key, F.lit("misread").alias("noise"))).distinct()


def cased(meant: str | None, as_in: str) -> str:
    """meant in the case of the word that it replaces: capitals, a capital at the start, or small; without a meaning the word itself."""
    letters = [c for c in as_in if c.isalpha()]
    if meant is None:
        return as_in
    return meant.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else meant[:1].upper() + meant[1:] if as_in[:1].isupper() else meant


def corrected(texts: DataFrame, wrong: DataFrame, key: str) -> DataFrame:
    """(key, text, noise): the texts with misread words put right; for their case see cased()."""
    fixes = wrong.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("fixes"))
    rows = texts.join(fixes, key, "left").select(F.col(key).alias("k"), "text", "noise", F.to_json("fixes").alias("fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import regex
        word = regex.compile(_WORD)
        for b in batches:
            done = []
            for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                if t is not None:
                    t = re.sub(_LIGATURE, lambda m: unicodedata.normalize("NFKC", m[0]), t)
                if t and f:
                    fix = json.loads(f)
                    t = word.sub(lambda m: cased(fix.get(m[0].lower()), m[0]), t)
                done.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string()), b.column(2)], names=["k", "text", "noise"])

    kind = texts.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, text string, noise array<string>").withColumnRenamed("k", key)
