"""A table kept up to date by a stream: one row a key, each batch applied once, readers never seeing half of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The ledger: ids of the batches that are committed, in order. A manifest counts once its writer has marked it complete."""
    fs, at = _files(spark, f"{folder}/manifest")
    if not fs.exists(at):
        return []
    named = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix("batch=")) for n, p in named if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def read_upserted(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as of its last committed batch, or as of ``version``."""
    known = versions(spark, folder)
    if not known:
        raise ValueError(f"no batch is committed in {folder}")
    return _rows(spark, folder, known[-1] if version is None else version).drop("__key_bucket", "__arrived")


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[int, str]:
    """Bucket to folder; no more entries than buckets."""
    return {r["bucket"]: r["path"] for r in spark.read.parquet(f"{folder}/manifest/batch={version}").collect()}


def _rows(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(*sorted(set(_manifest(spark, folder, version).values())))


def upsert(batch: DataFrame, batch_id: int, folder: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS) -> bool:
    """Apply one batch to the table in ``folder``; False if the ledger has it already, so that a replayed batch changes nothing.

    Of the rows of a key that with the largest ``order`` stays, then that of the latest batch. Keys are dealt into ``buckets`` by a hash, and only the buckets that
    the batch touches are read and written anew, beside the old ones. The manifest, which names each bucket's folder, is
    written last: until it is complete readers have the version before, and a batch that failed half-way is written over. An
    empty batch is put down in the ledger. Null keys are keys.
    """
    spark = batch.sparkSession
    known = versions(spark, folder)
    if batch_id in known:
        return False
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = batch.withColumns({"__key_bucket": bucket, "__arrived": F.lit(batch_id).cast("long")}).persist()
    try:
        touched = sorted(r["__key_bucket"] for r in rows.select("__key_bucket").distinct().collect())  # no more than there are buckets
        manifest = _manifest(spark, folder, known[-1]) if known else {}
        old = [manifest[b] for b in touched if b in manifest]
        both = rows.unionByName(spark.read.parquet(*old), allowMissingColumns=True) if old else rows
        kept = both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(*order, "__arrived")).alias("row")).select("row.*")
        target = f"{folder}/data/batch={batch_id}"
        if touched:
            kept.withColumn("bucket", F.col("__key_bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
        named = sorted((manifest | {b: f"{target}/bucket={b}" for b in touched}).items())
        spark.createDataFrame(named, "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")
    finally:
        rows.unpersist()
    return True


def forget(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete the data folders that none of the last ``keep`` versions names, and the manifests before them; the ledger's last entries stay. Returns what went."""
    known = versions(spark, folder)
    used = {p for v in known[-keep:] for p in _manifest(spark, folder, v).values()}
    gone = [f"{folder}/manifest/batch={v}" for v in known[:-keep]]
    fs, at = _files(spark, f"{folder}/data")
    for batch in fs.listStatus(at) if fs.exists(at) else []:
        for part in fs.listStatus(batch.getPath()):
            path = f"{folder}/data/{batch.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and path not in used and int(batch.getPath().getName().removeprefix("batch=")) <= (known[-1] if known else -1):
                gone.append(path)
    for path in gone:
        files, place = _files(spark, path)
        files.delete(place, True)
    return gone


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (), mode: str = "update", buckets: int = BUCKETS) -> None:
    """Process all that is there now of a stream into the table in ``folder``."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    writer.foreachBatch(lambda df, n: upsert(df, n, folder, keys, order, buckets) and None).start().awaitTermination()
