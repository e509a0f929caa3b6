"""Encoding with a public byte-level BPE vocabulary, without its library: longest matches, backtracking, pair compatibility.

A sequence of tokens is the BPE encoding of a string if and only if each two neighbours are the encoding of their own bytes.
So the encoder takes the longest token at each place, which an Aho-Corasick automaton over the bytes (as Latin-1 text) finds in
one pass, and goes back to a shorter one where two neighbours do not fit. Whether they fit is memoised; places that proved dead
are never entered again, so each place costs a bounded number of tries.
"""

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs, and characters of text, that each memo of a worker holds before it is emptied; longer texts than LONGEST are not kept.
MEMO, CHARS, LONGEST = 400_000, 6_000_000, 1_024

# A space or line feed before a visible character always starts a piece of the pattern, whatever stands before it.
_SPLIT = re.compile(r" (?=\S)").split
_LINES = re.compile(r"\n(?=\S)").split
_START = re.compile(r"[ \n](?=\S)").search
_UNEVEN = re.compile(r" (?:\s|\Z)").search


class _Units(dict):
    """Text between two places where pieces always start -> its ids as int32 bytes."""

    def __init__(self, encode, lead: str, lines: "_Units | None" = None):
        self.encode, self.lead, self.held, self.lines = encode, lead, 0, lines

    def __missing__(self, unit: str) -> bytes:
        if self.lines is not None and "\n" in unit and len(parts := _LINES(unit)) > 1:
            ids = self[parts[0]] + b"".join(map(self.lines.__getitem__, parts[1:]))
        else:
            ids = self.encode(self.lead + unit)
        if len(unit) <= LONGEST:
            if (held := self.held + len(unit) + 16) > CHARS:
                self.clear()
                held = 0
            self.held = held
            self[unit] = ids
        return ids


class _Pieces(dict):
    """Piece of the pattern -> its ids as int32 bytes."""

    def __init__(self, encode):
        self.encode, self.held = encode, 0

    def __missing__(self, p: str) -> bytes:
        ids = array("i", self.encode(p.encode("utf-8", "replace").decode("latin-1"))).tobytes()
        if len(p) <= LONGEST:
            self.held += len(p) + 16
            if self.held > CHARS:
                self.clear()
                self.held = 0
            self[p] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.text = {i: t for t, i in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PATTERN).findall
        self.known = _Pieces(self.piece)
        lines = _Units(self.unit, "\n")
        self.first, self.later = _Units(self.unit, "", lines), _Units(self.unit, " ", lines)

    def merged(self, s: str) -> list[int]:
        """The merges as defined, lowest rank first; for the bytes of two tokens at most."""
        parts = list(s)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        if (ok := self.fits.get((a, b))) is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            ok = self.fits[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return ok

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if (p := self.shorter.get(token)) is None:
            t = self.text[token]
            p = self.shorter[token] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1)
        return p

    def piece(self, s: str) -> list[int]:
        """s: the piece's UTF-8 bytes as Latin-1."""
        if (whole := self.rank.get(s)) is not None:
            return [whole]
        longest: list[tuple[int, int]] = [(0, -1)] * len(s)
        for end, found in self.automaton.iter(s):
            if found > longest[k := end - found[0] + 1]:
                longest[k] = found
        dead, out, at, token = bytearray(len(s) + 1), [], 0, longest[0][1]
        while True:
            size = len(self.text[token])
            if not dead[at + size] and (not out or self.fit(out[-1], token)):
                out.append(token)
                at += size
                if at == len(s):
                    return out
                token = longest[at][1]
            elif (p := self.prefix(token)) >= 0:
                token = p
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.text[token])

    def unit(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as int32 in this machine's order; of null and of an empty text none."""
        if not text:
            return b""
        units = _SPLIT(text) if _UNEVEN(text) else text.split(" ")
        return self.first[units[0]] + b"".join(map(self.later.__getitem__, units[1:]))

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4

    def count_upto(self, text: str, most: int) -> int | None:
        """count(), or None if it is over most; of a longer text only as much is encoded as tells it."""
        at = total = 0
        while m := _START(text, at + 8 * most + 1):
            total += self.count(text[at : m.start()])
            at = m.start()
            if total > most:
                return None
        total += self.count(text[at:])
        return total if total <= most else None


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(df: DataFrame, key: str, text: str, out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, out): the token ids of each row's text, without special tokens; their strings in a text are ordinary text.

    Null and empty texts have the empty list. Rows are kept as they are, repeated ones and null keys too. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            parts, offsets, size, start = [], [0], 0, 0
            keys, texts = b.column(0), b.column(1)
            for k in range(b.num_rows):
                parts.append(enc.encode_bytes(texts[k].as_py()))
                size += len(parts[-1]) // 4
                offsets.append(size)
                if size > 4_000_000 or k == b.num_rows - 1:
                    flat = pa.Array.from_buffers(pa.int32(), size, [None, pa.py_buffer(b"".join(parts))])
                    yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=[key, out])
                    parts, offsets, size, start = [], [0], 0, k + 1

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` array<int>")
