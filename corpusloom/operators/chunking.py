"""Documents to chunks: heading sections without a shuffle, windows and paragraph packing by an Arrow function."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What \s matches.
_SPACES = " \t\n\x0b\f\r"


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, source_path, title, chunk_index, section_title, content) of documents (doc_id, source_path, title, text).

    A line that starts with # opens a section, in code too; sections without content are dropped. Of several sections each is
    written as `## title`, a blank line and its content; a document of one section or none is one chunk as it stands, without
    a section title. Null and blank texts have no chunks.
    """
    rows = docs.filter(F.col("text").rlike(r"\S")).select("doc_id", "source_path", "title", F.posexplode(_section_array()).alias("chunk_index", "s"))
    return rows.select("doc_id", "source_path", "title", "chunk_index", "s.section_title", "s.content")


def windows(text: str, tokens: int, overlap: int) -> list[str]:
    """Windows of 4 bytes a token, cut after the last sentence end in them; the next begins where the overlap does, or at the cut."""
    data = text.encode()
    width, step, out, at = 4 * tokens, 4 * max(1, tokens - overlap), [], 0

    def snap(k: int, d: int) -> int:
        while 0 < k < len(data) and data[k] & 0xC0 == 0x80:
            k += d
        return k

    while text.strip() and at < len(data):
        at = snap(at, 1)
        end = snap(min(at + width, len(data)), -1)
        cut = end
        if end < len(data):
            last = max(data.rfind(c, at, end) for c in (b".", b"\n", b"!", b"?"))
            cut = last + 1 if last >= 0 else end
        piece = data[at:cut].decode("utf-8", "ignore").strip()
        if piece:
            out.append(piece)
        if cut >= len(data):
            break
        at = min(snap(min(at + step, len(data)), 1), cut)
    return out


def packed_paragraphs(text: str, tokens: int, overlap: int) -> list[str]:
    """Paragraphs put together while they fit into tokens of 4 bytes; larger ones as windows."""
    out, held = [], ""
    for p in text.split("\n\n"):
        if not p.strip():
            continue
        n = len(p.encode())
        if -(-n // 4) > tokens:
            out += ([held] if held else []) + windows(p, tokens, overlap)
            held = ""
        elif held and -(-(len(held.encode()) + 2 + n) // 4) <= tokens:
            held += "\n\n" + p
        else:
            out += [held] if held else []
            held = p
    return out + ([held] if held else [])


#: Bytes of a text, and the tokens and overlap of its chunks below that size; the last are those of larger ones.
PROFILE = ((512 << 10, 512, 64), (2 << 20, 1024, 128), (5 << 20, 2048, 256), (1 << 62, 3072, 384))


def chunks(docs: DataFrame, tokens: int | None = 512, overlap: int = 64) -> DataFrame:
    """sections() with those larger than tokens cut again: (doc_id, source_path, title, chunk_index, section_title, content, token_count).

    Without tokens, a text's size decides, see PROFILE. Pieces of a section lose its title. No shuffle: all chunks of a document come from
    its one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {n: [] for n in ("doc_id", "source_path", "title", "chunk_index", "section_title", "content", "token_count")}
            for doc, path, title, secs, size in zip(*(c.to_pylist() for c in b.columns)):
                k, (most, shared) = 0, (tokens, overlap) if tokens else next((t, o) for n, t, o in PROFILE if size < n)
                for s in secs:
                    small = -(-len(s["content"].encode()) // 4) <= most
                    whole = s["section_title"] is None and len(secs) == 1
                    parts = [s["content"]] if small and not whole else windows(s["content"], most, shared) if whole else packed_paragraphs(s["content"], most, shared)
                    for p in parts:
                        for n, v in zip(rows, (doc, path, title, k, s["section_title"] if small else None, p, -(-len(p.encode()) // 4))):
                            rows[n].append(v)
                        k += 1
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    arr = docs.filter(F.col("text").rlike(r"\S")).select("doc_id", "source_path", "title", _section_array().alias("secs"), F.octet_length("text").cast("bigint").alias("size"))
    return arr.mapInArrow(run, "doc_id bigint, source_path string, title string, chunk_index int, section_title string, content string, token_count int")


def _trimmed(c):
    return F.btrim(c, F.lit(_SPACES))


def _section_array():
    # Every text passes here, so its lines are cut without patterns, and one-element transforms bind what is used more than once.
    pieces = F.split(F.concat(F.lit("\n"), F.col("text")), "\n#")

    def named(ps):
        end = lambda i: F.when(i + 1 < F.size(ps), F.lit("\n")).otherwise("")
        return F.transform(ps, lambda p, i: F.struct(
            F.when(i > 0, _trimmed(F.ltrim(F.substring_index(p, "\n", 1), F.lit("#")))).alias("title"),
            F.when(i == 0, F.concat(F.substr(p, F.lit(2)), end(i))).when(F.contains(p, F.lit("\n")), F.concat(F.substr(p, F.instr(p, "\n") + 1), end(i))).otherwise("").alias("body")))

    def sections(full):
        many = F.transform(full, lambda s: F.struct(s["title"].alias("section_title"), F.when(s["title"].isNull(), s["body"]).otherwise(F.concat(F.lit("## "), s["title"], F.lit("\n\n"), s["body"])).alias("content")))
        return F.when(F.size(full) > 1, many).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("section_title"), _trimmed(F.col("text")).alias("content"))))

    full = F.get(F.transform(F.array(pieces), lambda ps: F.filter(named(ps), lambda s: s["body"].rlike(r"\S"))), F.lit(0))
    return F.get(F.transform(F.array(full), sections), F.lit(0))
