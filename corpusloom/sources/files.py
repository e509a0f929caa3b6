"""Files and rows to documents: discovery, delimited tables, chats, sessions, read-only SQL."""

import re

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# What discovery reads and passes over.
EXTENSIONS = ("md markdown pdf txt canvas json jsonl js ts jsx tsx rs py sh zsh bash yaml yml toml csv sql html css xml env local mdx conf").split()
SKIPPED = (".git .obsidian .entire node_modules target .next dist build coverage .venv venv vendor").split()


def is_readable(path: Column, extensions: list[str] = EXTENSIONS) -> Column:
    """The extension is on the list (any case, or an .env file) and no folder of the path is passed over."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (ext.isin(extensions) | F.startswith(name, F.lit(".env"))) & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIPPED])) & ~name.isin(".DS_Store", ".vault_index.db")


def glob_regex(pattern: str) -> str:
    """A wildcard pattern as a regular expression: ** over folders, * and ? within one, character classes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out, k = out + "[" + pattern[k + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if pattern[k + 1] == "!" else 0) + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a line of an ignore file matches: # comments, a leading / ties to the root, a trailing / names folders."""
    parts = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        rooted, folder, body = line.startswith("/"), line.endswith("/"), line.strip("/")
        parts.append(("" if rooted else "(?:.*/)?") + glob_regex(body) + ("/.*" if folder else "(?:/.*)?"))
    return path.rlike("^(?:" + "|".join(parts) + ")$") if parts else F.lit(False)


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(path, length, modificationTime, content) of the readable, non-empty files under a folder."""
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).filter("length > 0")
    inner = F.regexp_replace("path", "^.*?" + re.escape(base.replace("file://", "")) + "/", "")
    return df.filter(is_readable(F.col("path"), extensions) & ~ignored(inner, ignore or []))


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The result of one query. Spark's own parser says what it is: any part that writes, defines or sets something is refused,
    also one led by WITH."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError("only a single query is read") from e
    if found := _not_read(plan):
        raise ValueError(f"only a query is read, not {found}")
    return spark.sql(sql)


def _not_read(plan) -> str | None:
    """The name of a part of a logical plan that does more than read."""
    name = plan.getClass().getName()
    own = name.rpartition(".")[2]
    if ".catalyst.plans.logical." not in name and ".catalyst.analysis." not in name or re.search(
            "Command|Insert|Statement|Create|Drop|Alter|Delete|Update|Merge|Write|Append|Overwrite|Truncate|Set[A-Z]|Cache|Call|Execute|Load|Refresh|Repair|Rename|Replace|Script|Show|Describe", own):
        return own
    for kids in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for k in range(kids.size()):
            kid = kids.apply(k)
            if hasattr(kid, "getClass") and (found := _not_read(kid) if ".plans." in kid.getClass().getName() or ".analysis." in kid.getClass().getName() else None):
                return found
    return None


def row_documents(df: DataFrame, name: str, key: str, title: str | None, metadata: list[str], content: list[str]) -> DataFrame:
    """(doc_key, title, text) of rows: metadata as frontmatter, each content column as a section under its name; nulls left out."""
    head = F.coalesce(F.col(title).cast("string"), F.concat(F.lit(f"{name} "), F.col(key).cast("string"))) if title else F.concat(F.lit(f"{name} "), F.col(key).cast("string"))
    front = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), T.yaml_scalar(F.col(c).cast("string"))) for c in metadata])
    body = F.concat_ws("\n\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {c.replace('_', ' ').title()}\n\n"), F.col(c).cast("string"))) for c in content])
    return df.select(F.col(key).cast("string").alias("doc_key"), head.alias("title"), F.concat(F.lit("---\n"), front, F.lit("\n---\n\n# "), head, F.lit("\n\n"), body, F.lit("\n")).alias("text"))


def markdown_table(c: Column, separator: str = ",") -> Column:
    """A delimited text, a line a row, as a table: short rows are filled up, bars escaped."""
    rows = F.transform(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), lambda r: F.transform(F.split(r, re.escape(separator)), lambda x: F.replace(F.trim(x), F.lit("|"), F.lit("\\|"))))
    def build(rs: Column) -> Column:
        n = F.array_max(F.transform(rs, lambda r: F.size(r)))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
        done = F.transform(rs, line)
        return F.concat_ws("\n", F.slice(done, 1, 1), F.array(rule), F.slice(done, 2, F.greatest(F.size(done) - 1, F.lit(1))))
    return F.get(F.transform(F.array(rows), build), F.lit(0))


_CHAT = r"^\[(\d{1,2})/(\d{1,2})/(\d{2,4}), (\d{1,2}):(\d{2}):(\d{2})\] ([^:]+): (.*)$"


def chat_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, sender, body, n) of exported chats: lines without a date belong to the message before, all within one expression."""
    lines = F.split(F.regexp_replace(F.col(text), r"\n(?!\[\d{1,2}/\d{1,2}/\d{2,4}, \d{1,2}:\d{2}:\d{2}\] )", "\u0000"), "\n")
    m = df.select(F.col(key), F.posexplode(lines).alias("n", "line")).withColumn("line", F.replace("line", F.lit("\u0000"), F.lit("\n")))
    g = lambda k: F.regexp_extract("line", "(?s)" + _CHAT, k)
    year = F.when(F.length(g(3)) == 2, F.concat(F.lit("20"), g(3))).otherwise(g(3))
    at = F.try_make_timestamp(year.try_cast("int"), g(2).try_cast("int"), g(1).try_cast("int"), g(4).try_cast("int"), g(5).try_cast("int"), g(6).try_cast("double"))
    return m.filter(F.col("line").rlike("(?s)" + _CHAT)).select(key, "n", at.alias("at"), F.trim(g(7)).alias("sender"), F.trim(g(8)).alias("body"))


def monthly(messages: DataFrame, key: str) -> DataFrame:
    """(key, month, messages, senders, first_at, last_at) of chats by month."""
    return messages.groupBy(key, F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("sender").alias("senders"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def vault_title(text: Column, path: Column) -> Column:
    """The first `# ` line, else the file's stem."""
    h = F.regexp_extract(text, r"(?m)^# (.+)$", 1)
    return F.when(F.trim(h) != "", F.trim(h)).otherwise(T.file_stem(path))


def session_titles(df: DataFrame, key: str) -> DataFrame:
    """(key, title, messages, first_line) of session lines (key, line_no, role, text): the first user text, of 120 characters at most."""
    said = df.filter("role in ('user', 'human') and text is not null and trim(text) <> ''").groupBy(key).agg(F.min_by("text", "line_no").alias("t"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("messages"))
    return said.select(key, F.substring(F.trim(F.regexp_replace("t", r"\s+", " ")), 1, 120).alias("title"), "messages", "first_line")
