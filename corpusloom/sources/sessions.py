"""Session logs, a JSON object a line, to messages, turns and Markdown. Lines are parsed by the JVM; bad lines are passed over."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def json_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, line) of the .jsonl files under a folder, numbered from 1; blank lines are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "line")).filter(F.trim("line") != "").select("path", (F.col("at") + 1).alias("line_no"), "line")


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("line")).filter("v is not null")


def _get(path: str, of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, "string")


def block_text(content: Column) -> Column:
    """The text of a variant: a string as it is; of an array the texts of its items, tool calls as `[tool: name input]`, a line each."""
    get = F.try_variant_get
    item = lambda x: F.coalesce(
        F.when(F.trim(get(x, "$.text", "string")) != "", get(x, "$.text", "string")),
        F.when(get(x, "$.type", "string") == "tool_use", F.concat(F.lit("[tool: "), get(x, "$.name", "string"), F.lit(" "), F.coalesce(F.to_json(get(x, "$.input", "variant")), F.lit("")), F.lit("]"))))
    parts = F.filter(F.transform(get(content, "$", "array<variant>"), item), lambda t: t.isNotNull())
    kind = F.schema_of_variant(content)
    return F.when(kind == "STRING", get(content, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, "\n")).when(content.isNotNull() & (kind != "VOID"), F.to_json(content)).otherwise("")


def claude_messages(lines: DataFrame) -> DataFrame:
    """(session_id, project, cwd, branch, path, line_no, role, content, at) of the user's and the assistant's lines with text.

    A file is a session named by its stem, its folder the project; cwd and branch are the first that any of its lines has.
    """
    p = _parsed(lines).withColumns({"type": _get("$.type"), "cwd": _get("$.cwd"), "branch": _get("$.gitBranch")})
    first = p.groupBy("path").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), F.min_by("branch", F.when(F.col("branch").isNotNull(), F.col("line_no"))).alias("branch"))
    m = p.filter("type in ('user', 'assistant')").select("path", "line_no", F.coalesce(_get("$.message.role"), "type").alias("role"), block_text(F.try_variant_get("v", "$.message.content", "variant")).alias("content"), _get("$.timestamp").alias("at"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return m.filter(F.trim("content") != "").join(first, "path").select(T.file_stem(F.col("path")).alias("session_id"), T.project_name(folder).alias("project"), "cwd", "branch", "path", "line_no", "role", "content", "at")


def codex_messages(lines: DataFrame) -> DataFrame:
    """(session_id, cwd, path, line_no, role, content, at) of the response items said by user or assistant, with text.

    session_id and cwd are those of a file's last session_meta line, else the file's stem and null.
    """
    p = _parsed(lines).withColumn("type", _get("$.type"))
    meta = p.filter("type = 'session_meta'").select("path", "line_no", _get("$.payload.id").alias("id"), _get("$.payload.cwd").alias("cwd"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    meta = meta.groupBy("path").agg(last("id"), last("cwd"))
    get = F.try_variant_get
    items = F.filter(get("v", "$.payload.content", "array<variant>"), lambda x: get(x, "$.type", "string").isin("text", "input_text", "output_text") & (F.trim(get(x, "$.text", "string")) != ""))
    content = F.array_join(F.transform(items, lambda x: get(x, "$.text", "string")), "\n")
    m = p.filter("type = 'response_item'").select("path", "line_no", _get("$.payload.role").alias("role"), content.alias("content"), _get("$.timestamp").alias("at")).filter("role in ('user', 'assistant') and trim(content) <> ''")
    return m.join(meta, "path", "left").select(F.coalesce("id", T.file_stem(F.col("path"))).alias("session_id"), "cwd", "path", "line_no", "role", "content", "at")


def claude_turns(messages: DataFrame) -> DataFrame:
    """(source_path, line_no, section_title, content): a chunk a turn, headed by who speaks in which project."""
    head = F.concat(F.lit("["), "role", F.lit(" → "), "project", F.lit("]\n"))
    return messages.select(F.concat(F.lit("claude://"), "project", F.lit("#"), "session_id").alias("source_path"), "line_no", F.concat("role", F.lit(" message")).alias("section_title"), F.concat(head, "content").alias("content"))


def codex_turns(messages: DataFrame) -> DataFrame:
    head = F.concat(F.lit("["), "role", F.coalesce(F.concat(F.lit(" (cwd: "), "cwd", F.lit(")")), F.lit("")), F.lit("]\n"))
    return messages.select(F.concat(F.lit("codex://"), "session_id").alias("source_path"), "line_no", F.concat("role", F.lit(" message")).alias("section_title"), F.concat(head, "content").alias("content"))


def without_reminders(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<system-reminder>.*?</system-reminder>", ""))


def session_markdown(messages: DataFrame, most: int | None = None) -> DataFrame:
    """(session_id, title, text): a session's messages (session_id, line_no, role, content) as one document: the title is the first 120 characters
    of what the user said first, each message stands under its speaker; system reminders are dropped, messages cut at most characters.
    A document is one value, so a session is gathered here; for what must not be, use the turns."""
    said = without_reminders(F.col("content"))
    m = messages.select("session_id", "line_no", F.lower("role").alias("role"), (F.substring(said, 1, most) if most else said).alias("said")).filter("said <> ''")
    g = m.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "role", "said"))).alias("ms"))
    first = F.get(F.filter("ms", lambda x: x["role"] == "user"), F.lit(0))["said"]
    title = F.coalesce(F.substring(F.trim(F.regexp_replace(first, r"\s+", " ")), 1, 120), "session_id")
    body = F.array_join(F.transform("ms", lambda x: F.concat(F.lit("## "), F.initcap(x["role"]), F.lit("\n\n"), x["said"])), "\n\n")
    return g.select("session_id", title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n")).alias("text"))
