"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash; pass two
draws a Fisher-Yates permutation for each bucket and writes the bucket's rows in that order. Bucket
after bucket, the permuted rows make one uniformly shuffled sequence, which is cut into shards: the law
is ``rows``, so shards differ by one row at most and their slots have no gaps.

Only DataFrame functions run here. Rows cross one shuffle, into as many partitions as there are buckets;
counts and permutations are thin tables, written to the shared folder so that a task which is run again
sees the same. The seeded hash is that of all columns (but maps), so rows that share it are equal and
interchangeable. Where so many are equal that they overfill buckets, one of them is taken with its count and
repeated, and each repetition has a place of its own: no key gathers in one task.

Defined results: a null text has no bytes; null ids, ties and repeated rows are rows like any other; an
empty table gives an empty result. All columns of the input are kept; ``shard`` and ``slot`` replace
input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, free_names, load, materialize, scratch

N_SHARDS = 40
#: A bucket is meant to hold so many bytes of text, and so many rows, at most.
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 50_000
#: Rows of one hash from which they are taken as one row with a count.
HOT_ROWS = 5_000
#: Constant size of a record besides its text.
RECORD_BYTES = 16


def _counts(rows: DataFrame, bucket: str) -> DataFrame:
    return materialize(rows.groupBy(F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")


def _scattered(docs: DataFrame, key: str, bucket: str, seed: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their hash and bucket, hot hashes spread over all buckets; and the buckets' sizes (b, n)."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not f.dataType.simpleString().startswith("map<")]
    rows = docs.withColumn(key, F.xxhash64(F.lit(seed), *hashed))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).cast("int"))
    counts = _counts(rows, bucket)
    # only a bucket that is far too full can hold a hot hash
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / buckets
    crowded = counts.filter(F.col("n") > F.lit(2 * mean)).filter(F.col("n") >= HOT_ROWS).select(F.col("b").alias("__b"))
    if buckets == 1 or not crowded.take(1):
        return rows, counts
    hot = rows.join(F.broadcast(crowded), F.col(bucket) == F.col("__b")).groupBy(F.col(key).alias("h")).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= HOT_ROWS)
    hot_key, times, i = free_names(rows, "__hot", "__times", "__i")
    few = broadcast_if_small(materialize(hot.select(F.col("h").alias(hot_key), F.col("times").alias(times)), "hot-rows"))
    drop(counts)
    same = F.col(key) == F.col(hot_key)
    plain = rows.join(few, same, "left_anti")
    one = rows.join(few, same).groupBy(key, times).agg(*(F.first(f"`{c}`").alias(c) for c in docs.columns))
    many = one.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(times)))).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(buckets)).cast("int"))
    rows = plain.unionByName(many.select(*(F.col(f"`{c}`") for c in rows.columns)))
    return rows, _counts(rows, bucket)


def external_shuffle(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 17, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with ``shard`` (int, from 0) and ``slot`` (long, from 0), bucket by bucket."""
    docs = docs.drop("shard", "slot")
    key, bucket, first, order, row, at = free_names(docs, "__key", "__bucket", "__first", "__order", "__row", "__at")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + RECORD_BYTES
    # pass 1: how many buckets, how many rows in each
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    buckets = max(1, -(-(total.b or 0) // bucket_bytes), -(-total.n // bucket_rows))
    rows, counts = _scattered(docs, key, bucket, seed, buckets)
    # pass 2: a permutation and the first position of each bucket
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn(first, F.coalesce(F.sum("n").over(before), F.lit(0))).repartition(buckets, "b")
    plan = plan.select(F.col("b").alias(bucket), first, F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed).alias(order))
    plan = materialize(plan, "shuffle-plan").repartition(buckets, bucket)
    ranked = Window.partitionBy(bucket).orderBy(key)
    rows = rows.repartition(buckets, bucket).withColumn(row, F.row_number().over(ranked))
    placed = rows.join(plan.hint("merge"), bucket).withColumn(at, F.col(first) + F.element_at(order, F.col(row)))
    # positions to shards: the first ones have one row more
    each, more = divmod(total.n, n_shards)
    long = more * (each + 1)
    shard = F.expr(f"case when `{at}` < {long} then `{at}` div {each + 1} else {more} + (`{at}` - {long}) div {max(each, 1)} end")
    slot = F.expr(f"case when `{at}` < {long} then `{at}` % {each + 1} else (`{at}` - {long}) % {max(each, 1)} end")
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write each bucket's rows in the order of their slots, a folder for each shard, and return the written table.

    A bucket lies in one shard or a few neighbours, so that files are about as large as buckets.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)


def op10_sharding(spark, sf_dir) -> DataFrame:
    """Write all documents as shards in the shared folder and read them back."""
    out = write_shards(external_shuffle(load(spark, sf_dir, "documents")), scratch(spark, "shards"))
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
