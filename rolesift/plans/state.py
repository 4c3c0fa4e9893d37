"""Parquet state: keyed tables, append-only tables, staged results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.text import posting_hash
from rolesift.schema import conform


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


# Stands in for spark.checkpoint.dir on a local master.
_LOCAL_FOLDER = "/tmp/rolesift-shared"


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a local master,
    as in tests, gets a fixed folder; on a cluster, whose machines share no local folder, it is an
    error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(_LOCAL_FOLDER)
    return _LOCAL_FOLDER


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/rolesift/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write a result that several outputs read, and read it back.

    It cuts the lineage, survives lost executors, and stays columnar, so each reader gets only
    the columns it needs. ``folder`` keeps what belongs together, so it can be dropped at once.
    """
    path = f"{folder}/{label}" if folder else scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KeyedTable:
    """A keyed table as plain Parquet, partitioned by a hash bucket of its key; one writer at a time.

    A merge reads the buckets that its batch touches, writes the merged rows to ``pending/<token>`` and then lets
    Spark overwrite those partitions from there (``partitionOverwriteMode`` dynamic). The number of buckets is part
    of the path (``of=``), so a table keeps the one it was made with. A bucket is written by up to ``salts`` tasks.

    A merge that breaks off while it is staged has changed nothing, and the next one clears it away. Once
    staged, it is finished by whoever comes next, as overwriting partitions from the same rows again does no
    harm. ``done`` holds an empty file per finished token, so a merge that is asked for again is none. Merges must
    not empty a bucket, which upserts never do.
    """

    def __init__(
        self, spark: SparkSession, root: str, ddl: str, key: str, buckets: int = 16, salts: int = 16
    ) -> None:
        self.spark, self.root, self.ddl = spark, root.rstrip("/"), ddl
        self.key, self.new_buckets, self.salts = key, buckets, salts

    @property
    def rows(self) -> str:
        return f"{self.root}/rows"

    def buckets(self) -> int:
        """How many buckets the table has, or would get."""
        found = [int(n[3:]) for n in list_names(self.spark, self.rows) if n.startswith("of=")]
        return found[0] if found else self.new_buckets

    def _parts(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, of int, bucket int").parquet(path)

    def _stored(self) -> DataFrame:
        if not list_names(self.spark, self.rows):
            return self.spark.createDataFrame([], f"{self.ddl}, of int, bucket int")
        return self._parts(self.rows)

    def read(self) -> DataFrame:
        return self._stored().drop("of", "bucket")

    def tokens(self) -> list[str]:
        """Tokens of the finished merges, ascending."""
        return list_names(self.spark, f"{self.root}/done")

    def recover(self) -> None:
        """Finish what was staged whole, and clear away what was not."""
        for token in list_names(self.spark, f"{self.root}/pending"):
            if path_exists(self.spark, f"{self.root}/pending/{token}/_SUCCESS"):
                self._finish(token)
            else:
                drop_path(self.spark, f"{self.root}/pending/{token}")

    def _finish(self, token: str) -> None:
        pending = f"{self.root}/pending/{token}"
        self._overwrite(self._parts(pending))
        fs, path = _fs(self.spark, f"{self.root}/done/{token}")
        fs.create(path, True).close()
        drop_path(self.spark, pending)

    def _overwrite(self, rows: DataFrame) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("of", "bucket").parquet(self.rows)

    def merge(
        self, plan: Callable[[DataFrame], DataFrame], token: str, batch: DataFrame | None = None
    ) -> None:
        """Replace the rows of the touched buckets by ``plan(those rows)``, unless the token is done.

        ``batch`` has the keys that the plan may change or add; without it all buckets are touched."""
        self.recover()
        if token in self.tokens():
            return
        buckets = self.buckets()
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        stored = self._stored()
        if batch is not None:  # at most as many rows as there are buckets
            touched = [row[0] for row in batch.select(bucket).distinct().collect()]
            stored = stored.filter(F.col("bucket").isin(touched))
        merged = conform(plan(stored.drop("of", "bucket")), self.ddl)
        placed = merged.withColumns({"of": F.lit(buckets), "bucket": bucket})
        salt = F.pmod(F.xxhash64(F.lit("salt"), self.key), F.lit(self.salts))
        staged = placed.repartition("bucket", salt).write.mode("overwrite").partitionBy("of", "bucket")
        staged.parquet(f"{self.root}/pending/{token}")
        self._finish(token)


class AppendTable:
    """Rows are only ever added; every append is a directory named by its token, written once."""

    def __init__(self, spark: SparkSession, root: str, ddl: str) -> None:
        self.spark, self.root, self.ddl = spark, root.rstrip("/"), ddl

    def read(self) -> DataFrame:
        if not list_names(self.spark, self.root):
            return self.spark.createDataFrame([], self.ddl)
        parts = self.spark.read.schema(f"{self.ddl}, part string").parquet(self.root)
        return parts.drop("part")

    def has(self, token: str) -> bool:
        return path_exists(self.spark, f"{self.root}/part={token}/_SUCCESS")

    def append(self, df: DataFrame, token: str | None = None) -> None:
        """Nothing happens if the token has been appended before."""
        part = token or uuid.uuid4().hex
        if not self.has(part):
            conform(df, self.ddl).write.mode("overwrite").parquet(f"{self.root}/part={part}")


def mark_applied(table: AppendTable, postings: DataFrame, notes: str = "") -> None:
    """Append applied postings, named by job_hash or by company_name, title and location (which
    may be absent); repeats are allowed."""

    def cell(name: str) -> Column:
        return F.col(name) if name in postings.columns else F.lit(None).cast("string")

    computed = posting_hash(cell("company_name"), cell("title"), cell("location"))
    rows = postings.select(
        F.coalesce(cell("job_hash"), computed).alias("job_hash"),
        F.current_timestamp().alias("applied_at"),
        F.lit(notes).alias("notes"),
    )
    table.append(rows)
