"""Snapshots of sources and what changed between them, incremental upkeep of derived tables, published generations."""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import get_text, listed, put_new


def snapshot(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; keys whose last row has a null content_hash are gone."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*").filter("content_hash is not null")


def manifest_diff(before: DataFrame, after: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """(*key, change): added, modified, removed or unchanged."""
    a, b = (df.select(*key, F.struct(*compare).alias(n)) for df, n in ((before, "x"), (after, "y")))
    return a.join(b, key, "full").select(*key, F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x").eqNullSafe(F.col("y")), "unchanged").otherwise("modified").alias("change"))


def replaced(derived: DataFrame, fresh: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """derived without the rows of keys that were modified or removed, and with fresh rows of those added or modified."""
    touched = changes.filter("change in ('modified', 'removed')").select(*key)
    new = changes.filter("change in ('added', 'modified')").select(*key)
    return derived.join(touched, key, "left_anti").unionByName(fresh.join(new, key, "left_semi"))


def belongs(path: Column, kind: Column, root: Column) -> Column:
    """Whether a path is of a source: by scheme, as the very file, or inside the folder (part by part, not as a prefix of text)."""
    bare = F.regexp_replace(root, "/+$", "")
    return F.when(kind.isin("claude", "codex"), F.startswith(path, F.concat(kind, F.lit("://")))).when(kind == "file", path == root).when(
        kind.isin("folder", "obsidian"), (path == bare) | F.startswith(path, F.concat(bare, F.lit("/")))).otherwise(False)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns' values, in order, nulls apart from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def row_import(before: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, outcome): imported, updated, skipped, removed, or failed for keys that are null or come twice."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(row_hash(columns)).alias("new"))
    j = n.filter(F.col(key).isNotNull()).join(before.select(key, F.col("hash").alias("old")), key, "full")
    out = F.when(F.col("n") > 1, "failed").when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "imported").when(F.col("old") == F.col("new"), "skipped").otherwise("updated")
    return j.select(key, out.alias("outcome"))


def interval_seconds(c: Column) -> Column:
    """Seconds of `15m`, `2h`, `1d`; null for anything else or nothing."""
    n = F.regexp_extract(c, r"^\s*(\d{1,9})\s*[mhd]\s*$", 1).try_cast("bigint")
    return n * F.when(F.rtrim(c).endswith("m"), 60).when(F.rtrim(c).endswith("h"), 3600).otherwise(86400)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], added: bool = False) -> int:
    """Write the tables as the next generation and give its number.

    Each goes to a folder of its own that no other run writes to; last comes the generation's marker, a small file that names the
    folders of every table. What a run that fails before that leaves behind is seen by nobody and overwritten by nobody, and of two
    runs that want the same number one fails. With added, the rows are added to those of the generation before; tables not given
    stay as they are.
    """
    now, folder = state(spark, root), f"data/{uuid.uuid4().hex}"
    names = {n: list(p) for n, p in now["tables"].items()}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{folder}/{name}")
        names[name] = [*(names.get(name, []) if added else []), f"{folder}/{name}"]
    n = next_generation(spark, root)
    put_new(spark, f"{root}/generations/{n:010d}", json.dumps({"generation": n, "tables": names, "whole": True}))
    return n


def next_generation(spark: SparkSession, root: str) -> int:
    """The number after those of all markers, whole or not."""
    return int(max(["0", *listed(spark, f"{root}/generations")], key=int)) + 1


def state(spark: SparkSession, root: str) -> dict:
    """The newest generation that is whole: {generation, tables: {name: folders}}; 0 and no tables before the first.

    A marker that a run could not finish is passed over, and so is one of whose folders any is not there: the generation before counts.
    """
    for name in reversed(listed(spark, f"{root}/generations")):
        try:
            s = json.loads(get_text(spark, f"{root}/generations/{name}") or "")
        except ValueError:
            continue
        if s.get("whole") and all("_SUCCESS" in listed(spark, f"{root}/{p}") for ps in s["tables"].values() for p in ps):
            return s
    return {"generation": 0, "tables": {}}


def published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table of the newest whole generation; None where there is none."""
    paths = state(spark, root)["tables"].get(name)
    return spark.read.parquet(*[f"{root}/{p}" for p in paths]) if paths else None
