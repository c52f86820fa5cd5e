"""Change capture and last-writer-wins merging.

A change is a full row image: (seq, change_id, table, row_id, operation upsert or delete, payload JSON,
hlc, device_id, created_at_ms). Of the changes of a row the one with the greatest (hlc, device_id,
change_id) wins; a delete is a version too, so an older upsert does not bring a row back.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "seq long, change_id string, table string, row_id string, operation string, payload string, hlc string, device_id string, created_at_ms long"
#: A change from further in the future is refused.
MAX_SKEW_MS = 24 * 3600 * 1000
MAX_PAYLOAD_BYTES = 64 * 1024


class HybridClock:
    """Monotone clock of 16 hex digits of milliseconds, a dash and 8 of a counter: texts sort as times."""

    def __init__(self, now=lambda: int(time.time() * 1000)):
        self.now, self.ms, self.count = now, 0, 0

    def tick(self) -> str:
        ms = self.now()
        if ms > self.ms:
            self.ms, self.count = ms, 0
        else:
            self.count += 1
        return self.text()

    def observe(self, other: str) -> str:
        """Move past another clock's reading."""
        ms, count = parse(other)
        if (ms, count) > (self.ms, self.count):
            self.ms, self.count = ms, count
        return self.tick()

    def text(self) -> str:
        return f"{self.ms:016x}-{self.count:08x}"


def parse(hlc: str) -> tuple[int, int]:
    """Milliseconds and counter of a reading."""
    if len(hlc) != 25 or hlc[16] != "-":
        raise ValueError(f"malformed clock reading {hlc!r}")
    return int(hlc[:16], 16), int(hlc[17:], 16)


def hlc_ms(column: str = "hlc"):
    return F.conv(F.substring(column, 1, 16), 16, 10).cast("long")


def capture(before: DataFrame, after: DataFrame, key: str, table: str) -> DataFrame:
    """Changes that lead from one snapshot to the next: (table, row_id, operation, payload).

    One full outer join on the key; rows whose image is the same give none.
    """
    image = F.to_json(F.struct(*after.columns), {"ignoreNullFields": "false"})
    old = before.select(F.col(key).alias("k"), F.to_json(F.struct(*before.columns), {"ignoreNullFields": "false"}).alias("was"))
    new = after.select(F.col(key).alias("k"), image.alias("payload"))
    both = old.join(new, "k", "full").filter(~F.col("was").eqNullSafe(F.col("payload")))
    gone = F.col("payload").isNull()
    return both.select(F.lit(table).alias("table"), F.col("k").cast("string").alias("row_id"), F.when(gone, "delete").otherwise("upsert").alias("operation"), F.coalesce("payload", "was").alias("payload"))


def backfill(df: DataFrame, key: str, table: str) -> DataFrame:
    """Every row as an upsert."""
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("row_id"), F.lit("upsert").alias("operation"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))


def after(changes: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next page of changes behind a cursor."""
    return changes.filter(F.col("seq") > cursor).orderBy("seq").limit(limit)


def validate(changes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Valid changes, and refused ones with ``reason``."""
    reason = (
        F.when(F.col("change_id").isNull() | F.col("row_id").isNull() | F.col("table").isNull(), "missing field")
        .when(~F.col("operation").isin("upsert", "delete"), "unknown operation")
        .when(~F.coalesce(F.col("hlc").rlike("^[0-9a-f]{16}-[0-9a-f]{8}$"), F.lit(False)), "malformed clock")
        .when(hlc_ms() > now_ms + MAX_SKEW_MS, "from the future")
        .when(F.octet_length("payload") > MAX_PAYLOAD_BYTES, "payload too large")
        .when((F.col("operation") == "upsert") & F.col("payload").isNull(), "missing payload")
    )
    marked = changes.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def conflicts(changes: DataFrame) -> DataFrame:
    """Ids that name different contents."""
    content = F.xxhash64("table", "row_id", "operation", "payload", "hlc", "device_id")
    return changes.groupBy("change_id").agg(F.min(content).alias("a"), F.max(content).alias("b")).filter("a <> b").select("change_id")


def deduplicate(changes: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Each change id once, and none that was applied before."""
    out = changes.dropDuplicates(["change_id"])
    return out if applied is None else out.join(applied.select("change_id"), "change_id", "left_anti").select(*changes.columns)


def winners(changes: DataFrame) -> DataFrame:
    """The deciding version of each row, by a partial aggregate: a hot row is reduced before the shuffle."""
    columns = [c for c in changes.columns if c not in ("table", "row_id")]
    best = F.max_by(F.struct(*columns), F.struct("hlc", "device_id", "change_id"))
    return changes.groupBy("table", "row_id").agg(best.alias("__v")).select("table", "row_id", "__v.*").select(*changes.columns)


def apply_changes(versions: DataFrame, changes: DataFrame, applied: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New versions of all rows (tombstones too), and (decision, n): applied, ignored, duplicate."""
    fresh = deduplicate(changes, applied)
    merged = winners(versions.select(*changes.columns).unionByName(fresh))
    won = merged.select("change_id").join(fresh.select("change_id"), "change_id", "left_semi")
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    counts = one(changes, "all").union(one(fresh, "fresh")).union(one(won, "won"))
    of = {k: F.sum(F.when(F.col("kind") == k, F.col("n"))) for k in ("all", "fresh", "won")}
    decided = [("applied", of["won"]), ("ignored", of["fresh"] - of["won"]), ("duplicate", of["all"] - of["fresh"])]
    report = counts.agg(F.array(*(F.struct(F.lit(k).alias("decision"), n.alias("n")) for k, n in decided)).alias("r")).select(F.inline("r"))
    return merged, report


def rows(versions: DataFrame, table: str, schema: str) -> DataFrame:
    """The live rows of a table."""
    live = versions.filter((F.col("table") == table) & (F.col("operation") == "upsert"))
    return live.select(F.from_json("payload", schema).alias("r")).select("r.*")


def apply_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep the versions of all rows below ``path``: each micro-batch writes the next generation.

    Generations are named by batch, so a batch that is run again after a failure writes the same one.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        past = f"{path}/generation={n - 1}"
        old = spark.read.schema(SCHEMA).parquet(past) if n else spark.createDataFrame([], SCHEMA)
        merged, _ = apply_changes(old, batch)
        merged.write.mode("overwrite").parquet(f"{path}/generation={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


