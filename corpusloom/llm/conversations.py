"""Conversations from message rows by keyed streaming state with event-time watermarks.

The state of a key (agent, session, file, stretch of line numbers) gathers the numbers and speakers of lines as they arrive, in any
order, and drops lines delivered again. Event time is the time of arrival: a key closes when the watermark has passed its last
arrival by the timeout, and its segment is emitted; a line that comes later still opens the key once more, and validation puts the
segments of a key together. Texts do not go through the state; they are joined to the messages of whole conversations. Segments are
bounded by the stretch, so a session of any size is spread over many keys, and validation and ordering work on segments, not lines.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.skew import split_cumulate
from corpusloom.session import cut
from corpusloom.streaming.drain import replay

#: Lines of one file that one key's state holds.
STRETCH = 1_024
# The spellings of the speakers, in lower case; every other role is no speaker.
USER, ASSISTANT = ("user", "human"), ("assistant", "agent", "model")
#: What shows: neither white space, control, format and private characters, nor blank letters.
VISIBLE = "[^\\\\s\\\\p{Z}\\\\p{C}\\u115F\\u1160\\u2800\\u3164\\uFFA0\\uFE00-\\uFE0F]".replace("\\\\", "\\")

def moment(c: str) -> Column:
    """A timestamp from ISO notation in any zone, or from a number of seconds or milliseconds; else null."""
    s = F.trim(F.col(c))
    return F.when(s.rlike(r"^\d{12,14}$"), F.timestamp_millis(s.try_cast("bigint"))).when(
        s.rlike(r"^\d{9,11}$"), F.timestamp_seconds(s.try_cast("bigint"))).otherwise(s.try_cast("timestamp"))


def _lines(df: DataFrame, agent: str, file: str, is_message: Column, role: str, content: str, with_text: bool) -> DataFrame:
    r = F.lower(F.trim(F.col(role)))
    texts = F.transform(F.col(content), lambda x: x["text"])
    shown = F.coalesce(F.exists(texts, lambda x: F.coalesce(x.rlike(VISIBLE), F.lit(False))), F.lit(False))
    code = F.when(is_message & shown & r.isin(*USER), 1).when(is_message & shown & r.isin(*ASSISTANT), 2).otherwise(0)
    kept = F.when(code > 0, F.array_join(F.filter(texts, lambda x: x.isNotNull()), "\n")) if with_text else F.lit(None)
    return df.filter("session_id is not null").select(
        F.lit(agent).alias("agent"), "session_id", F.coalesce(F.col(file), F.lit("")).alias("file"), F.coalesce("line_no", F.lit(0)).cast("int").alias("line_no"),
        F.coalesce(code, F.lit(0)).alias("code"), moment("timestamp").alias("at"), "ingested_at", kept.cast("string").alias("text"))


def codex_lines(df: DataFrame, with_text: bool = False) -> DataFrame:
    """The lines of codex sessions, of a table or a stream, as rows of one form; code is 1 for a user's message, 2 for an assistant's."""
    message = F.coalesce((F.col("type") == "response_item") & (F.col("payload.type") == "message"), F.lit(False))
    return _lines(df, "codex", "rollout_path", message, "payload.role", "payload.content", with_text)


def droid_lines(df: DataFrame, with_text: bool = False) -> DataFrame:
    return _lines(df, "droid", "file_path", F.coalesce(F.col("type") == "message", F.lit(False)), "message.role", "message.content", with_text)


def open_segments(lines: DataFrame, timeout: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """The stateful operator, for a stream of lines with arrived: (agent, session_id, file, stretch, lines, at, ingested_at), emitted when
    a key has had no line for the timeout. Arrivals may come to the stream out of order by the lateness."""
    return (lines.withWatermark("arrived", lateness)
            .groupBy(F.session_window("arrived", timeout), "agent", "session_id", "file", F.expr(f"(line_no - 1) div {STRETCH}").alias("stretch"))
            .agg(F.collect_set(F.struct("line_no", "code")).alias("lines"), F.min("at").alias("at"), F.min("ingested_at").alias("ingested_at"))
            .drop("session_window"))


def arrivals(lines: DataFrame) -> DataFrame:
    """lines with arrived: when a line came in, or, where that is not known, when it was written, or the beginning of time."""
    return lines.withColumn("arrived", F.coalesce("ingested_at", "at", F.lit("1970-01-01").cast("timestamp")))


def replayed(lines: DataFrame, timeout: str = "1 day", lateness: str = "1 hour", root: str | None = None, progress: list | None = None) -> DataFrame:
    """The segments of a table of lines, all of them: the table is read in the order of arrival, see drain.replay(). A run with a root of its
    own that fails is taken up by the next with the same root."""
    rows = arrivals(lines.drop("text"))
    marker = {"agent": "", "session_id": "", "file": "", "line_no": 1, "code": 0, "arrived": "9990-01-01 00:00:00"}
    return replay(lines.sparkSession, rows, lambda s: open_segments(s, timeout, lateness), "arrived", marker, "conversations", root, progress=progress)


def _closed(segments: DataFrame) -> DataFrame:
    """One row a key, though its lines may have come in several windows: messages in order, and what validation needs.

    A line number given twice with different contents counts once, as the first in order of its contents.
    """
    key = ["agent", "session_id", "file", "stretch"]
    s = segments.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.min("at").alias("at"), F.min("ingested_at").alias("ingested_at"))
    s = s.withColumn("lines", F.expr("filter(lines, (x, i) -> i = 0 or x.line_no > lines[i - 1].line_no)"))
    s = s.withColumn("messages", F.expr("filter(lines, x -> x.code > 0)"))
    turns = F.array_join(F.transform("messages", lambda x: x["code"].cast("string")), "")
    return s.select(*key, "at", "ingested_at", "messages", F.size("lines").alias("n_lines"), F.element_at("lines", 1)["line_no"].alias("least"),
                    F.element_at("lines", -1)["line_no"].alias("most"), turns.alias("turns"))


def _ordered(closed: DataFrame) -> DataFrame:
    """Adds file_at: files follow each other by their earliest time (of lines without one, of arrival), then by name."""
    w = Window.partitionBy("agent", "session_id", "file")
    return closed.withColumn("file_at", F.coalesce(F.min("at").over(w), F.min("ingested_at").over(w)))


def verdicts(segments: DataFrame) -> DataFrame:
    """(agent, session_id, n_messages, empty, starts_wrong, unanswered, incomplete, broken) of each session.

    empty: no message. starts_wrong: the first message is not the user's. unanswered: a user's message without an assistant's
    before the next user's or the end. incomplete: the line numbers of a file do not run from 1 without a hole (a null number
    is one). broken: any of these.
    """
    who = ["agent", "session_id"]
    segs = _ordered(_closed(segments)).drop("messages")
    files = segs.groupBy(*who, "file").agg(((F.min("least") != 1) | (F.max("most") != F.sum("n_lines"))).alias("holes")).groupBy(*who).agg(F.max("holes").alias("incomplete"))
    # Segments in ranges of equal size: neighbours are compared within a range, then the ends of the ranges with each other.
    order = ["file_at", "file", "stretch"]
    place = F.struct(*order)
    spoken = cut(segs.filter("turns <> ''").select(*who, *order, "turns").repartitionByRange(*who, *order).withColumn("_range", F.spark_partition_id()), "turns")

    def joined(df: DataFrame, group: list, by: list) -> Column:
        return F.coalesce((F.substring("first", 1, 1) == "1") & (F.lag("last").over(Window.partitionBy(*group).orderBy(*by)) == "1"), F.lit(False))

    one = spoken.select("*", F.substring("turns", 1, 1).alias("first"), F.substring("turns", -1, 1).alias("last"), F.contains("turns", F.lit("11")).alias("bad"))
    one = one.withColumn("bad", F.col("bad") | joined(one, [*who, "_range"], order))
    many = one.groupBy(*who, "_range").agg(F.min_by("first", place).alias("first"), F.max_by("last", place).alias("last"), F.max("bad").alias("bad"), F.sum(F.length("turns")).alias("n"))
    many = many.withColumn("bad", F.col("bad") | joined(many, who, ["_range"]))
    talks = many.groupBy(*who).agg(F.min_by("first", "_range").alias("first"), F.max_by("last", "_range").alias("last"), F.max("bad").alias("bad"), F.sum("n").alias("n"))
    empty = F.col("n").isNull()
    v = files.join(talks, who, "left").select(
        *who, F.coalesce("n", F.lit(0)).alias("n_messages"), empty.alias("empty"), (~empty & (F.col("first") != "1")).alias("starts_wrong"),
        (~empty & (F.col("bad") | (F.col("last") == "1"))).alias("unanswered"), "incomplete")
    return v.select("*", (F.col("empty") | F.coalesce("starts_wrong", F.lit(False)) | F.coalesce("unanswered", F.lit(False)) | F.col("incomplete")).alias("broken"))


def messages(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """(agent, session_id, seq, role, text, file, line_no): the messages of the sessions that are not broken, seq from 0; lines are those
    that the segments were made of, with their texts. A line given twice with different texts has the first in order."""
    good = verdicts(segments).filter("not broken").select("agent", "session_id")
    segs = _ordered(_closed(segments)).filter("turns <> ''").join(good, ["agent", "session_id"], "left_semi").withColumn("n", F.size("messages").cast("long"))
    placed = split_cumulate(segs.select("agent", "session_id", "file_at", "file", "stretch", "messages", "n"), ["agent", "session_id"],
                            [F.col("file_at"), F.col("file"), F.col("stretch")], "n", "before")
    one = placed.select("agent", "session_id", "file", "before", F.posexplode("messages").alias("k", "m")).select(
        "agent", "session_id", "file", "m.line_no", "m.code", (F.col("before") + F.col("k")).alias("seq"))
    line = ["agent", "session_id", "file", "line_no", "code"]
    texts = lines.filter("code > 0").groupBy(*line).agg(F.min("text").alias("text"))
    return one.join(texts, line).select("agent", "session_id", "seq", F.when(F.col("code") == 1, "user").otherwise("assistant").alias("role"), "text", "file", "line_no")
