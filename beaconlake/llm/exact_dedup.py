"""Exact deduplication over a stream with disk-backed keyed state, in DataFrame functions only.

Texts are normalised (each run of ASCII white space becomes one space) and digested with SHA-256.
Digests enter a streaming aggregation whose state is kept in RocksDB without expiry: by digest, the
smallest identifier, the locator (file and row) of the row that stays, and the number of rows.

Digests seen more than once are hits, and only for those are full bytes compared: the texts of hits are
sought by digest, and their least and greatest normalised text must be the same bytes. Copies meet in
map-side sums, so a group of any size costs a row a task. Up to ``BROADCAST_HITS`` hit digests go to every
executor and texts without a hit never leave their task; beyond that the texts meet the hits in a shuffled
join. Rows whose texts differ in spite of equal digests are regrouped by the texts themselves.

A state folder given as ``state`` is kept: a later call with other rows goes on from it, so the keeper may
be a row of an earlier call (``kept`` is then false for all rows of its group), and group sizes count all
calls. The files that the rows came from are noted there, and the bytes of a hit on an earlier row are read
from its file. Without ``state`` the folder lives as long as the call.

Defined cases: null counts as empty, so all null, empty and blank-to-"" texts are one group; a null
doc_id sorts after all others; of rows with equal doc_id and text the first by locator stays; an
empty table gives an empty result; extra columns of any name stay in :func:`drop_copies` and are left out by
:func:`exact_groups`.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.llm.common import SPACE, discard, located, make_dir, materialize, of, remove, row_name, scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}
#: Digest rows of one micro-batch come from so many bytes of digest files at most.
BATCH_BYTES = 256 << 20
#: Up to so many digests of hits are sent to every executor (about 100 bytes each); more go through a shuffled join.
BROADCAST_HITS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256 in hex, cut to so many bits; tests cut it to force equal digests of different texts."""
    whole = F.sha2(text, 256)
    return whole if bits == 256 else F.substring(whole, 1, bits // 4)


@contextlib.contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_groups(spark: SparkSession, digests: str, schema, state: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Runs all digest files that the state in ``state`` hasn't seen through the stateful aggregation.

    Returns one row per digest: keeper (struct of the row that stays) and group_size. The state stays
    in that folder; a later call with the same folder and more files goes on from it.
    """
    updates = f"{state}/updates"
    seen = (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(digests)
        .groupBy("key").agg(F.min("row").alias("keeper"), F.count("*").alias("group_size"))
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with _conf(spark, STREAM_CONF):
        seen.writeStream.outputMode("update").foreachBatch(put).option(
            "checkpointLocation", f"{state}/checkpoint"
        ).trigger(availableNow=True).start().awaitTermination()
    out = f"key string, keeper {schema['row'].dataType.simpleString()}, group_size long, batch int"
    try:
        versions = spark.read.schema(out).parquet(updates)
    except Exception as error:  # no batch has run: there were no rows
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], out).drop("batch")
    last = versions.groupBy("key").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("last"))
    return last.select("key", "last.keeper", "last.group_size")


def _texts(rows: DataFrame, text: str, bits: int) -> DataFrame:
    """Per row of :func:`located`: key (its digest), loc and norm."""
    norm = normalised(of(text).cast("string"))
    return rows.select(F.col("loc"), norm.alias("norm")).select(digest("norm", bits).alias("key"), "loc", "norm")


def _earlier(spark: SparkSession, state: str, hits: DataFrame, text: str, bits: int) -> DataFrame | None:
    """Texts of earlier calls, from the files that hold a row with a hit's digest."""
    files = spark.read.schema("path string, file long").parquet(f"{state}/files")
    rows = spark.read.schema("key string, row struct<unnamed: boolean, doc_id: bigint, at: struct<file: bigint, row: bigint>>").parquet(f"{state}/digests")
    holding = rows.join(hits, "key", "left_semi").select(F.col("row.at.file").alias("file")).distinct()
    paths = [r["path"] for r in files.join(holding, "file", "left_semi").select("path").distinct().collect()]  # a path a file
    return _texts(located(spark.read.parquet(*paths)), text, bits) if paths else None


def _true_groups(texts: DataFrame, hits: DataFrame, rows: DataFrame) -> DataFrame | None:
    """For digests that different texts share: own_at, true_keeper and true_size of their rows; None if there are none.

    texts has key, loc and norm; hits has the keys that occur twice or more; rows has key and row.
    """
    few = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    shared = texts.join(few, "key", "left_semi")
    ends = shared.groupBy("key").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    mixed = materialize(ends.filter("least <> most").select("key"), "mixed-digests")
    if mixed.isEmpty():
        discard(mixed)
        return None
    own = texts.join(mixed, "key", "left_semi").select("loc", "norm")
    own = own.join(rows.join(mixed, "key", "left_semi").select("row"), F.col("loc") == F.col("row.at"))
    apart = own.groupBy("norm").agg(F.min("row").alias("true_keeper"), F.count("*").alias("true_size"))
    apart = materialize(own.join(apart, "norm").select(F.col("loc").alias("own_at"), "true_keeper", "true_size"), "apart")
    discard(mixed)
    return apart


def grouped(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 256, state: str | None = None) -> DataFrame:
    """Per row of :func:`located`: at (its locator), doc_id, keeper, group_size, sha256."""
    spark = rows.sparkSession
    folder = state or scratch(spark, "exact-dedup")
    texts = _texts(rows, text, bits)
    own = rows.select(row_name(doc_id).alias("row"), normalised(of(text).cast("string")).alias("norm"))
    own = own.select(digest("norm", bits).alias("key"), "row", *([] if bits == 256 else [F.sha2("norm", 256).alias("sha256")]))
    schema = own.select("key", "row").schema
    if state:
        now = materialize(own, "digests")
        make_dir(spark, f"{folder}/files")
        now.select("key", "row").write.mode("append").parquet(f"{folder}/digests")
    else:
        own.write.parquet(f"{folder}/digests")
        now = spark.read.schema(own.schema).parquet(f"{folder}/digests")
    groups = materialize(stream_groups(spark, f"{folder}/digests", schema, f"{folder}/state"), "exact-groups")
    hits = groups.filter("group_size > 1").select("key")
    every = now
    if state:
        hits = hits.join(now.select("key"), "key", "left_semi")
        every = spark.read.schema(schema).parquet(f"{folder}/digests")
    hits = materialize(hits, "hits")
    if state:
        earlier = _earlier(spark, folder, hits, text, bits)
        texts = texts if earlier is None else texts.unionByName(earlier)
        files = spark.read.parquet(*rows.inputFiles()).select(F.col("_metadata.file_path").alias("path")).distinct() if rows.inputFiles() else None
        if files is not None:
            files.withColumn("file", F.xxhash64("path")).write.mode("append").parquet(f"{folder}/files")
    apart = _true_groups(texts, hits, every.select("key", "row"))
    discard(hits)
    if not state:
        remove(spark, f"{folder}/state")
    sha = F.col("key") if bits == 256 else F.col("sha256")
    out = now.join(groups, "key").select("row", sha.alias("sha256"), "keeper", "group_size")
    if apart is not None:
        out = out.join(apart, out["row.at"] == apart["own_at"], "left").select(
            "row", "sha256", F.coalesce("true_keeper", "keeper").alias("keeper"),
            F.coalesce("true_size", "group_size").alias("group_size"),
        )
    return out.select("row.at", "row.doc_id", "keeper", "group_size", "sha256")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 256, state: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return grouped(located(docs), text, doc_id, bits, state).select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("at") == F.col("keeper.at")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", state: str | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    rows = located(docs)
    gone = grouped(rows, text, doc_id, state=state).filter(F.col("at") != F.col("keeper.at")).select("at")
    return rows.join(gone, F.col("loc") == F.col("at"), "left_anti").select("doc.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
