"""Exact deduplication as a streaming job with disk-backed keyed state.

The stream keeps one state row per digest, for ever: the digest, the stable identifier of the row
that stays (the largest), the number of rows and the content locator (the file that holds the
row). The state lives in RocksDB and is checkpointed to the shared folder, so a restarted job goes
on from its last micro-batch and a lost executor reloads its part. A digest that is hit more than
once is a claim; the claim is checked on the full bytes, and rows whose bytes differ although
their digests agree are grouped by the text itself.

Only DataFrame operations run on the executors.

Defined cases: a null text counts as empty; an empty table gives no rows; a repeated row counts as
a copy of itself, and rows that repeat the largest identifier of their group all stay; rows with a null identifier are counted and marked, and stay only if the group
has no identifier at all; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrely.llm.common import ascii_lower, hot_groups
from acrely.session import forget_at_exit, fresh_dir

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no megabytes reserved per state partition
}
BATCH_BYTES = 256 * 1024 * 1024  # input of one micro-batch
SPLIT_ROWS = 20_000              # rows of a hot group that are compared in one task

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: str) -> Column:
    return F.coalesce(ascii_lower(F.col(text)), F.lit(""))


def _hashed(docs: DataFrame, doc_id: str, text: str, digest: Digest) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("_text")).withColumn(
        "text_sha256", digest(F.col("_text")))


def follow(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The parquet files of `path` as a stream, about `batch_bytes` of them at a time.

    The path is given as a pattern because only then a table may also be one single file.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")


def keep_state(
    stream: DataFrame, out: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text",
    digest: Digest = sha256, trigger: dict | None = None,
):
    """Start the stateful job: every micro-batch writes the state rows it changed to `out`."""
    seen = stream.select(
        F.col(doc_id).alias("doc_id"), digest(normalised(text)).alias("text_sha256"),
        F.col("_metadata.file_path").alias("locator"))
    state = seen.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "locator")).alias("keeper"))

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select("text_sha256", "group_size", F.col("keeper.doc_id").alias("keep_id"), "keeper.locator")
        flat.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def read_state(spark: SparkSession, out: str, id_type: str = "bigint") -> DataFrame:
    """The newest state row of every digest. Counts and identifiers only ever grow."""
    rows = spark.read.schema(f"text_sha256 string, group_size long, keep_id {id_type}, locator string").parquet(out)
    last = F.max(F.struct("group_size", "keep_id", "locator")).alias("s")
    return rows.groupBy("text_sha256").agg(last).select("text_sha256", "s.*")


def differing(hashed: DataFrame, state: DataFrame, rows: int) -> DataFrame:
    """Digests whose rows do not all have the same bytes.

    Rows of digests that were hit are compared within their group. A hot group is dealt out over
    several tasks, and each part sends on only its smallest and largest text.
    """
    hits = state.filter(F.col("group_size") > 1).select("text_sha256", "group_size")
    hot = hot_groups(hits, ["text_sha256"], "group_size", rows).withColumn(
        "_parts", F.ceil(F.col("group_size") / SPLIT_ROWS).cast("int") + 15).drop("group_size")
    hot = F.broadcast(hot)  # at most a thousand rows, see hot_groups
    dealt = hashed.join(hot, "text_sha256", "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"), F.lit(0)))
    wanted = hits.join(hot, "text_sha256", "left").select(
        "text_sha256", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    claimed = dealt.join(wanted, ["text_sha256", "_part"])
    ends = claimed.groupBy("text_sha256", "_part").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
    return ends.groupBy("text_sha256").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter(
        F.col("low") != F.col("high")).select("text_sha256")


def exact_dedup(
    spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", digest: Digest = sha256,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per row of the parquet table at `path`: doc_id, keep_id, group_size, kept, text_sha256, locator."""
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        return named.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), F.col("text").alias("text_sha256"), F.col("text").alias("locator"))
    out, checkpoint = fresh_dir(spark, "dedup-state"), fresh_dir(spark, "dedup-checkpoint")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = keep_state(follow(spark, path, batch_bytes), out, checkpoint, doc_id, text, digest)
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        for folder in (out, checkpoint):
            forget_at_exit(spark, folder)

    state = read_state(spark, out, docs.schema[doc_id].dataType.simpleString())
    rows = state.agg(F.sum("group_size")).first()[0] or 0
    hashed = _hashed(docs, doc_id, text, digest)
    collided = differing(hashed, state, rows)
    spoilt = [r.text_sha256 for r in collided.limit(1).collect()]

    marked = hashed.select("doc_id", "text_sha256").join(state, "text_sha256")
    if spoilt:  # digests that lie: their rows are grouped by the text itself
        marked = marked.join(collided, "text_sha256", "left_anti")
        apart = hashed.join(collided, "text_sha256", "left_semi")
        groups = apart.groupBy("text_sha256", "_text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        marked = marked.unionByName(
            apart.join(groups, ["text_sha256", "_text"]).withColumn("locator", F.lit(None).cast("string")).drop("_text"))
    return marked.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")
