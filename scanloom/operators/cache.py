"""Cached model responses as a table: keys, lookup within a time to live, cleaning, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days after which a response counts as gone.
TTL_DAYS = 30


def response_key(chunk: Column, template: Column, model: Column) -> Column:
    """Digest of chunk, template and model."""
    return F.sha2(F.concat_ws(":", chunk, template, model), 256)


def retrieval_key(chunk: Column, language: Column) -> Column:
    """Digest of chunk and language."""
    return F.sha2(F.concat(chunk, language), 256)


def shard(key: Column) -> Column:
    """The folder a key is kept in: its first two characters; the partition column of a cache table."""
    return F.substring(key, 1, 2)


def fresh(entries: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Entries not older than ``days``; the latest of a key."""
    ok = entries.where(F.col("stored_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    rest = [c for c in ok.columns if c != "key"]
    return ok.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("stored_at")).alias("x")).select("key", "x.*")


def lookup(work: DataFrame, entries: DataFrame, now: Column, days: int = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """(work with its cached response, work without one): a join on the key and its anti join; null keys are never cached."""
    live = fresh(entries, now, days)
    return work.join(live, "key"), work.join(live.select("key"), "key", "left_anti")


def statistics(entries: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """One row: entries, stale ones, bytes of responses, oldest and newest."""
    stale = F.col("stored_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")
    return entries.agg(F.count("*").alias("entries"), F.count_if(stale).alias("stale"), F.coalesce(F.sum(F.octet_length("response")), F.lit(0)).alias("bytes"), F.min("stored_at").alias("oldest"), F.max("stored_at").alias("newest"))


def hits_if_cached(requests: DataFrame, key: str) -> DataFrame:
    """One row: requests, misses (first of each key) and hits that a cache of any size would have."""
    per = requests.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count("*").alias("misses"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("hits"))


def save(entries: DataFrame, path: str) -> None:
    """Append responses (key, stored_at, response) to a cache table, parted by shard."""
    entries.withColumn("shard", shard(F.col("key"))).write.mode("append").partitionBy("shard").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A cache table; one that was never written is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "key string, stored_at timestamp, response string")
    return spark.read.schema("key string, stored_at timestamp, response string, shard string").parquet(path).drop("shard")


def clean(spark: SparkSession, path: str, now: Column, days: int = TTL_DAYS) -> int:
    """Drop stale and superseded entries; how many went.  The new table is written beside the old one and takes its place."""
    old = load(spark, path)
    beside = f"{path.rstrip('/')}.new"
    before = old.count()
    if not before:
        return 0
    save_mode = fresh(old, now, days).withColumn("shard", shard(F.col("key")))
    save_mode.write.mode("overwrite").partitionBy("shard").parquet(beside)
    kept = load(spark, beside).count()
    clear(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path_of(beside), path_of(path))
    return before - kept


def clear(spark: SparkSession, path: str) -> None:
    """Remove a cache table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hit_rate(log: DataFrame, hit: str) -> DataFrame:
    """One row of a request log: requests, hits, misses, rate (0 without requests); a null counts as a miss."""
    h = F.count_if(F.coalesce(F.col(hit), F.lit(False)))
    return log.agg(F.count("*").alias("requests"), h.alias("hits"), (F.count("*") - h).alias("misses"), F.round(F.when(F.count("*") > 0, h / F.count("*")).otherwise(0.0), 6).alias("rate"))
