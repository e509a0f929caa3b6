"""Processing only new or changed records: a ledger of what successful runs covered, a low-water mark, and an anti-join.

A run covers an interval of a source's sequence. Intervals of one source may be many and may overlap, so they are not joined
with its records pair by pair: each is cut into at most two aligned blocks of every power of two, a block keeps the latest
time of the runs that hold it, and a record looks up the block it lies in on each level.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: A window sorts at most 2^16 numbers of one source and path together; a longer history is cut into such stretches.
STRETCH_BITS = 16

#: On level v both ends, rounded inwards to blocks of 2^v numbers, leave at most one block each that level v + 1 misses.
_BLOCKS = """filter(flatten(transform(
    sequence(0, cast(floor(log2(last_sequence - first_sequence + 1)) as int)),
    v -> array(
        named_struct('level', v, 'block', shiftright(first_sequence + shiftleft(1L, v) - 1, v),
                     'ok', shiftright(first_sequence + shiftleft(1L, v) - 1, v) % 2 != 0),
        named_struct('level', v, 'block', shiftright(last_sequence + 1, v) - 1, 'ok', shiftright(last_sequence + 1, v) % 2 != 0)
    ))), b -> b.ok and b.block >= shiftright(first_sequence + shiftleft(1L, b.level) - 1, b.level)
              and b.block < shiftright(last_sequence + 1, b.level))"""


def successful_runs(checkpoints: DataFrame, segments: DataFrame) -> DataFrame:
    """(source_key, first_sequence, last_sequence, done_ms) of each run whose newest row is completed with all files processed.

    Rows that tie for newest count by their generation, then processed_files. A run without a published generation, or whose
    generation has no segment with a range, covers nothing.
    """
    newest = checkpoints.filter("run_id is not null").groupBy("run_id").agg(F.max(F.struct(
        "updated_unix_ms", "generation", "processed_files", "status", "total_files", "source_key")).alias("r")).select("r.*")
    good = newest.filter("status = 'completed' and processed_files = total_files and generation is not null")
    ranges = segments.select("generation", "source_key", "wal_range.first_sequence", "wal_range.last_sequence").filter(
        "first_sequence <= last_sequence").distinct()
    return good.select("generation", "source_key", F.col("updated_unix_ms").alias("done_ms")).join(ranges, ["generation", "source_key"]).select(
        "source_key", "first_sequence", "last_sequence", "done_ms")


def first_deliveries(records: DataFrame) -> DataFrame:
    """One row (source_key, wal_sequence, received_ms, file_path, content_hash) a record; rows without a key are no records."""
    far = F.lit(2**63 - 1)
    return (records.filter("source_key is not null and wal_sequence is not null").groupBy("source_key", "wal_sequence")
            .agg(F.min(F.struct(F.coalesce("received_ms", far).alias("at"), "file_path", "content_hash")).alias("f"))
            .select("source_key", "wal_sequence", F.when(F.col("f.at") < far, F.col("f.at")).alias("received_ms"), "f.file_path", "f.content_hash"))


def ledger(first: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_key, wal_sequence, version) of each record that some run covers; a record never received counts for none."""
    blocks = runs.select("source_key", "done_ms", F.explode(F.expr(_BLOCKS)).alias("b")).groupBy(
        "source_key", F.col("b.level").alias("level"), F.col("b.block").alias("block")).agg(F.max("done_ms").alias("done_ms"))
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())  # at most 64 numbers, whatever the data
    look = first.filter("received_ms is not null").select("source_key", "wal_sequence", "received_ms", "content_hash", F.explode(
        F.array(*[F.lit(v) for v in levels]).cast("array<int>")).alias("level")).withColumn("block", F.expr("shiftright(wal_sequence, level)"))
    return look.join(blocks, ["source_key", "level", "block"]).filter("received_ms <= done_ms").select(
        "source_key", "wal_sequence", F.col("content_hash").alias("version")).distinct()


def low_water(first: DataFrame, done: DataFrame) -> DataFrame:
    """(source_key, low_sequence, low_ms): the lowest sequence of each source still open, that is, in no ledger row, and the mark.

    low_ms is when the oldest open record arrived, or, where none is open, the newest of all: what arrives later, even with a
    low sequence, lies at or above it. low_sequence is null where nothing is open.
    """
    marked = first.join(done.select("source_key", "wal_sequence", F.lit(True).alias("closed")).distinct(), ["source_key", "wal_sequence"], "left")
    return marked.groupBy("source_key").agg(
        F.min(F.when(F.col("closed").isNull(), F.col("wal_sequence"))).alias("low_sequence"),
        F.coalesce(F.min(F.when(F.col("closed").isNull(), F.col("received_ms"))), F.max("received_ms")).alias("low_ms"))


def unchanged(first: DataFrame) -> DataFrame:
    """(source_key, wal_sequence) of records whose non-null hash equals that of the record before it of the same source and path."""
    b = F.expr(f"shiftright(wal_sequence, {STRETCH_BITS})")
    rows = first.filter("file_path is not null").withColumn("stretch", b)
    group = ["source_key", "file_path"]
    tails = rows.groupBy(*group, "stretch").agg(F.max(F.struct("wal_sequence", "content_hash")).alias("t"))
    carry = tails.select(*group, "stretch", F.lag("t.content_hash").over(Window.partitionBy(*group).orderBy("stretch")).alias("carry")).filter(
        "carry is not null")
    w = Window.partitionBy(*group, "stretch").orderBy("wal_sequence")
    own = rows.select(*group, "stretch", "wal_sequence", "content_hash", F.row_number().over(w).alias("at"), F.lag("content_hash").over(w).alias("prev"))
    inside = own.filter("at > 1 and content_hash = prev")
    across = own.filter("at = 1 and content_hash is not null").join(carry, [*group, "stretch"]).filter("content_hash = carry")
    return inside.select("source_key", "wal_sequence").unionByName(across.select("source_key", "wal_sequence"))


def pending(first: DataFrame, done: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """Records that the next run of each source must get: not in the ledger with this version, and not saved unchanged.

    low, where given, is what low_water() said after the last run: records that arrived before its low_ms are not read again.
    A source without a mark is new and read whole. Empty tables give no rows. Columns as in first_deliveries().
    """
    if low is not None:
        mark = low.select("source_key", "low_ms")
        first_open = first.join(mark, "source_key", "left").filter("low_ms is null or received_ms is null or received_ms >= low_ms").drop("low_ms")
    else:
        first_open = first
    hit = (F.col("f.source_key") == F.col("d.source_key")) & (F.col("f.wal_sequence") == F.col("d.wal_sequence")) & F.col("f.content_hash").eqNullSafe(F.col("d.version"))
    todo = first_open.alias("f").join(done.alias("d"), hit, "left_anti")
    return todo.join(unchanged(first), ["source_key", "wal_sequence"], "left_anti")


def next_batch(records: DataFrame, checkpoints: DataFrame, segments: DataFrame) -> DataFrame:
    """pending() with the ledger that the checkpoints and segments stand for, from the mark of each source's last run."""
    first, runs = cut(first_deliveries(records), "first"), cut(successful_runs(checkpoints, segments), "runs")
    done = cut(ledger(first, runs), "ledger")
    last = runs.groupBy("source_key").agg(F.max("done_ms").alias("last_ms"))
    seen = first.join(last, "source_key").filter("received_ms <= last_ms").drop("last_ms")
    return pending(first, done, low_water(seen, done))
