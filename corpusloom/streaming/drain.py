"""Running a stateful stream over a bounded input: read in the order of time, so that state closes as the watermark passes, with exactly-once output in the shared folder, taken up again where a run that failed left off."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import get_text, listed, make, move, new_path, put_new, remove

#: Rows of one step of a replay, more or less: what the state has to hold grows with a step and the time that keys stay open.
STEP = 20_000_000


def replay(spark: SparkSession, source: DataFrame, build: Callable[[DataFrame], DataFrame], time: str, marker: dict, name: str = "stream", root: str | None = None,
           steps: int = 4, progress: list | None = None) -> DataFrame:
    """What build(stream) emits in append mode by the end of source, read in steps that follow each other by the timestamp column time.

    The source is written once, without a shuffle, parted by time at its quantiles (steps parts at least, more for more than STEP rows
    each; rows without a time come first); each part is then handed to the stream in turn. So whatever lateness build() allows, no row
    comes too late, and a key closes once the rows of later steps have moved the watermark past it. marker gives a row from
    beyond all time (columns not named are null): read last, it closes what is still open. What the marker's own key emits must be
    recognisable; its state stays open.

    With a root of its own, a run that failed is taken up by the next with the same arguments: parts written, steps done and offsets
    are kept there, and the result stays when it is whole. Without one, a new folder is used. progress, if given, gets the number of
    rows in state and of rows emitted after each step.
    """
    root = root or new_path(spark, name)
    plan, staged, src, state, out = (f"{root}/{x}" for x in ("plan", "staged", "in", "state", "out"))
    if get_text(spark, plan) is None:
        for half in (staged, src):
            remove(spark, half)
        at = F.unix_micros(time).cast("double")
        n = max(steps, -(-source.count() // STEP))
        cuts = sorted(set(source.select(at.alias("t")).approxQuantile("t", [k / n for k in range(1, n)], 0.01)))  # numbers, as many as steps
        part = sum((F.coalesce((at >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
        source.withColumn("_part", part).write.partitionBy("_part").parquet(staged)
        make(spark, src)
        put_new(spark, plan, "\n".join(f"{p:012d}" for p in sorted(int(x.partition("=")[2]) for x in listed(spark, staged) if x.startswith("_part="))))
    result = build(spark.readStream.schema(source.schema).option("recursiveFileLookup", True).parquet(src))

    def run() -> None:
        q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if progress is not None and q.recentProgress:
            ops = q.lastProgress["stateOperators"]
            progress.append((sum(o["numRowsTotal"] for o in ops), sum(o["numRowsRemoved"] for p in q.recentProgress for o in p["stateOperators"])))

    back = spark.read.schema(result.schema).parquet
    if get_text(spark, f"{root}/done"):
        return back(out)
    there = listed(spark, src)
    if "end" not in there:
        for p in get_text(spark, plan).split():
            if f"p{p}" not in there:
                move(spark, f"{staged}/_part={int(p)}", f"{src}/p{p}")
            run()  # of a part that is already read, nothing is read again
        ends = f"{root}/ends"
        end = spark.range(1).select(*[F.lit(marker.get(f.name)).cast(f.dataType).alias(f.name) for f in source.schema.fields])
        end.coalesce(1).write.mode("overwrite").parquet(ends)
        move(spark, ends, f"{src}/end")
    run()
    put_new(spark, f"{root}/done", "whole")
    remove(spark, staged)
    remove(spark, state)
    return back(out)
