"""Files to documents: text, delimited tables, JSON, notebooks, HTML; what a page-wise text repeats at its page edges is taken out."""

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.files import EXTENSIONS, discover, vault_title

_NOTEBOOK = "struct<cells: array<struct<cell_type: string, source: variant>>>"


def delimited_markdown(text: str, separator: str = ",") -> str:
    """A delimited text as a table: quoted fields may hold separators and line ends (written <br>), short rows are filled up, bars escaped."""
    csv.field_size_limit(2**31 - 1)
    rows = [[" ".join(c.split(" ")).strip().replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>") for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if any(c.strip() for c in r)]
    if not rows:
        return ""
    n = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (n - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])])


def delimited_tables(df: DataFrame, key: str, text: str, separator: str = ",") -> DataFrame:
    """(key, table) of each row; null stays null. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else delimited_markdown(t, separator) for t in b.column(1).to_pylist()], pa.string())], names=[key, "table"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, table string")


def notebook_markdown(c: Column) -> Column:
    """A notebook's cells in order: code between fences, the rest as it stands; empty cells left out. Null if it is none."""
    nb = F.from_json(c, _NOTEBOOK)
    source = lambda s: F.coalesce(F.array_join(F.try_variant_get(s, "$", "array<string>"), ""), F.try_variant_get(s, "$", "string"), F.lit(""))
    cell = lambda x: F.when(x["cell_type"] == "code", F.concat(F.lit("```python\n"), source(x["source"]), F.lit("\n```"))).otherwise(source(x["source"]))
    full = F.filter(nb["cells"], lambda x: F.trim(source(x["source"])) != "")
    return F.when(nb["cells"].isNotNull(), F.array_join(F.transform(full, cell), "\n\n"))


def json_markdown(c: Column) -> Column:
    """JSON in order of its keys between fences; null if it is none."""
    return F.concat(F.lit("```json\n"), F.to_json(F.try_parse_json(c), {"pretty": "true"}), F.lit("\n```"))


def cleaned_pages(c: Column, share: float = 0.6) -> Column:
    """A text of pages parted by form feeds without the first and last lines that stand so on a share of its pages (three at least), and with
    words rejoined that a hyphen breaks over a line end."""
    lines = lambda p: F.filter(F.split(p, "\n"), lambda x: F.trim(x) != "")

    def build(pages: Column) -> Column:
        n = F.size(pages)
        heads, feet = F.transform(pages, lambda p: F.trim(F.get(lines(p), F.lit(0)))), F.transform(pages, lambda p: F.trim(F.element_at(F.concat(F.array(F.lit("")), lines(p)), -1)))
        often = lambda xs: F.filter(F.array_distinct(xs), lambda x: (F.size(F.filter(xs, lambda y: y == x)) >= F.greatest(F.ceil(n * share), F.lit(3))) & (x != ""))
        def strip(p: Column) -> Column:
            ls = lines(p)
            a = F.when(F.array_contains(often(heads), F.trim(F.get(ls, F.lit(0)))), F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))).otherwise(ls)
            return F.when((F.size(a) > 0) & F.array_contains(often(feet), F.trim(F.element_at(F.concat(F.array(F.lit("")), a), -1))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
        return F.array_join(F.transform(pages, lambda p: F.array_join(strip(p), "\n")), "\n\n")

    text = F.get(F.transform(F.array(F.split(c, "\f")), build), F.lit(0))
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")


def converted(files: DataFrame) -> DataFrame:
    """(source_path, title, text, converter) of files (path, content), by their extension; files of other formats have a null text and the
    converter `unsupported`, so that they can be counted and none is lost in silence."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    f = files.select(F.col("path").alias("source_path"), ext.alias("ext"), raw.alias("raw"))
    rows = delimited_tables(f.filter("ext in ('csv')"), "source_path", "raw", ",").unionByName(delimited_tables(f.filter("ext = 'tsv'"), "source_path", "raw", "\t")).select("source_path", F.col("table").alias("text"), F.lit("table").alias("converter"))
    other = f.filter("ext not in ('csv', 'tsv')")
    kind = F.when(F.col("ext") == "ipynb", "notebook").when(F.col("ext") == "json", "json").when(F.col("ext").isin("html", "htm"), "html").when(F.col("ext").isin([e for e in EXTENSIONS if e not in ("pdf", "json", "html", "csv")] + [""]), "text").otherwise("unsupported")
    text = F.when(kind == "notebook", notebook_markdown(F.col("raw"))).when(kind == "json", F.coalesce(json_markdown(F.col("raw")), "raw")).when(kind == "html", T.html_text(F.col("raw"))).when(kind == "text", F.col("raw"))
    both = other.select("source_path", text.alias("text"), kind.alias("converter")).unionByName(rows)
    return both.select("source_path", vault_title(F.coalesce("text", F.lit("")), F.col("source_path")).alias("title"), "text", "converter")


def read_documents(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """converted() of the readable files under a folder."""
    return converted(discover(spark, root, ignore, [*EXTENSIONS, "ipynb", "tsv", "htm"]).select("path", "content"))


def file_import(before: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(path, sha256, outcome) of files (path, content) against a manifest (path, sha256): imported, updated, skipped, removed, or too_large."""
    now = files.select("path", F.when(F.length("content") <= most, F.sha2("content", 256)).alias("new"), F.lit(True).alias("here"))
    j = now.join(before.select("path", F.col("sha256").alias("old")), "path", "full")
    out = F.when(F.col("here").isNull(), "removed").when(F.col("new").isNull(), "too_large").when(F.col("old").isNull(), "imported").when(F.col("old") == F.col("new"), "skipped").otherwise("updated")
    return j.select("path", F.coalesce("new", "old").alias("sha256"), out.alias("outcome"))
