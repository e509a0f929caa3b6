"""Cutting oversized texts at natural boundaries by agglomerative merging.

A text begins as atomic segments: sentences, lines, code lines; longer ones are cut between words, and words longer than the
limit between characters. Adjacent segments are merged, those at the weakest boundary first, as long as the merged size plus
the overlap fits; the boundaries left over, the strongest, are where the text is cut.
"""

import heapq
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokenizer import VOCABULARY, Encoder, encoder

WORD, SENTENCE, LINE, PARAGRAPH, SECTION = 1, 2, 3, 4, 5

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_SECTION = re.compile(r"#{1,6}\s|={2,}\s|\\(?:sub)*section\b|(?:-{3,}|\*{3,}|_{3,})\s*$|\*\*(?:User|Assistant|System):\*\*|<h[1-6]\b")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*\s+")
_WORD = re.compile(r"\S+\s*")
_GAP = re.compile(r"\s(?=\S)")


def atoms(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before it) of each segment; together they are the text."""
    out: list[tuple[int, int, int]] = []
    fenced = blank = False
    at = 0
    while at < len(text):
        end = _LINE.match(text, at).end()
        line = text[at:end]
        if not line.strip():
            if out:  # a blank line belongs to what stands before it
                out[-1] = (out[-1][0], end, out[-1][2])
            else:
                out.append((at, end, LINE))
            blank = True
        else:
            fence = bool(_FENCE.match(line))
            if not fenced and _SECTION.match(line):
                strength = SECTION
            elif blank and not fenced:
                strength = PARAGRAPH
            else:
                strength = LINE
            cuts = [] if fenced or fence else [m.end() for m in _SENTENCE.finditer(line) if m.end() < len(line)]
            for a, b in zip([0, *cuts], [*cuts, len(line)]):
                out.append((at + a, at + b, SENTENCE if a else strength))
            fenced, blank = fenced ^ fence, False
        at = end
    return out


def _reach(enc: Encoder, text: str, start: int, end: int, most: int) -> int:
    """The greatest k in (start, end] for which text[start:k] has no more than most tokens; start + 1 at least."""
    lo, hi = start + 1, min(end, start + 8)
    while hi < end and enc.count(text[start:hi]) <= most:
        lo, hi = hi, min(end, start + 2 * (hi - start))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if enc.count(text[start:mid]) <= most else (lo, mid - 1)
    return lo


def _finer(enc: Encoder, text: str, a: int, b: int, strength: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """The segment as words put together up to most tokens, with the sizes; words beyond that as runs of characters."""
    start, size = a, 0
    for m in _WORD.finditer(text, a, b):
        n = enc.count(m[0]) + 1
        if size and size + n > most:
            yield start, m.start(), strength if start == a else WORD, size
            start, size = m.start(), 0
        if n > most:
            while start < m.end():
                k = _reach(enc, text, start, m.end(), most - 1)
                yield start, k, strength if start == a else 0, enc.count(text[start:k]) + 1
                start = k
            size = 0
        else:
            size += n
    if start < b:
        yield start, b, strength if start == a else WORD, max(size, enc.count(text[start:b]))


def _tail(enc: Encoder, text: str, a: int, b: int, most: int) -> int:
    """Where the last most tokens of text[a:b] begin: at a word if one begins there, else at a character."""
    if most <= 0:
        return b
    lo, hi, span = a, b, 8
    while b - span > a and enc.count(text[b - span : b]) <= most:
        hi, span = b - span, 2 * span
    lo = max(a, b - span)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if enc.count(text[mid:b]) <= most else (mid + 1, hi)
    k = lo
    while k < b and not (k == a or text[k - 1].isspace() and not text[k].isspace() and enc.count(text[k:b]) <= most):
        k = m.end() if (m := _GAP.search(text, k, b)) else b
    return k if k < b else lo


def pieces(enc: Encoder, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, own, end, tokens) of each piece text[start:end]: what stands before own is the end of the piece before.

    No piece has more than limit tokens; the overlap is the longest run of words of the piece before that has no more than
    overlap tokens. The parts text[own:end] are the text, in order, nothing left out or twice.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    if (total := enc.count_upto(text, limit)) is not None:
        return [(0, 0, len(text), total)]
    most = limit - overlap
    parts: list[tuple[int, int, int, int]] = []
    for a, b, strength in atoms(text):
        n = enc.count(text[a:b]) + 1  # one more, for tokens that arise where segments meet
        parts += [(a, b, strength, n)] if n <= most else _finer(enc, text, a, b, strength, most)
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    end, size, alive = [p[1] for p in parts], [p[3] for p in parts], [True] * len(parts)
    heap = [(parts[k + 1][2], size[k] + size[k + 1], k, k + 1) for k in range(len(parts) - 1)]
    heapq.heapify(heap)
    while heap:
        _, n, a, b = heapq.heappop(heap)
        if not alive[a] or not alive[b] or after[a] != b or n != size[a] + size[b] or n > most:
            continue
        alive[b], end[a], size[a], after[a] = False, end[b], n, after[b]
        if after[a] >= 0:
            before[after[a]] = a
            heapq.heappush(heap, (parts[after[a]][2], n + size[after[a]], a, after[a]))
        if before[a] >= 0:
            heapq.heappush(heap, (parts[a][2], size[before[a]] + n, before[a], a))
    out: list[tuple[int, int, int, int]] = []
    spans = deque((parts[k][0], end[k]) for k in range(len(parts)) if alive[k])
    while spans:
        own, stop = spans.popleft()
        start = _tail(enc, text, out[-1][1], own, overlap) if out else own
        n = enc.count(text[start:stop])
        while n > limit and start < own:
            start = _tail(enc, text, out[-1][1], own, (enc.count(text[start:own]) * 3) // 4)
            n = enc.count(text[start:stop])
        if n > limit:  # tokens of neighbouring segments are rarely more than the sum; if so, cut where it fits
            mid = _reach(enc, text, own, stop, limit)
            spans.extendleft([(mid, stop), (own, mid)])
            continue
        out.append((start, own, stop, n))
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int, overlap: int, with_text: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, start, own, stop, n_tokens[, piece_text]): the pieces of each row's text, numbered from 0; see pieces().

    Places are counted in characters. A text within the limit is one piece; so is an empty or null one, of no tokens (its
    piece_text is empty or null). Rows stay apart even if they are alike or their key is null. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            names = [key, "piece", "start", "own", "stop", "n_tokens"] + ["piece_text"] * with_text
            at, rows, cols, held = [], [[] for _ in names[1:6]], [], 0
            keys = b.column(0)
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py()
                for no, (start, own, stop, n) in enumerate(pieces(enc, t or "", limit, overlap)):
                    at.append(k)
                    for c, v in zip(rows, (no, start, own, stop, n)):
                        c.append(v)
                    if with_text:
                        cols.append(t if t is None else t[start:stop])
                        held += stop - start
                if held > 16_000_000 or k == b.num_rows - 1:
                    arrays = [keys.take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in rows)] + [pa.array(cols, pa.string())] * with_text
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    at, rows, cols, held = [], [[] for _ in names[1:6]], [], 0

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start int, own int, stop int, n_tokens int" + ", piece_text string" * with_text
    return df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
