"""What the corpus operators share: tables, the shared folder, row locators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as all contracts here define it: a class for Java's, Python's and DuckDB's patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there is part of a lineage that reads it later."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    table = spark.read.schema(df.schema).parquet(at)
    table.scratch_path = at
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes what :func:`materialize` wrote, once no plan reads it; frames that it did not write are left alone."""
    for table in tables:
        if table is not None and (path := getattr(table, "scratch_path", None)):
            remove(table.sparkSession, path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files: these else stay until the driver's garbage collector finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


#: Tables of so many rows at most may be broadcast where Spark judges them small.
MOST_SENT = 100_000


def unsent(table: DataFrame, n: int | None = None) -> DataFrame:
    """A side of a join that never goes through the driver, unless its n rows are few.

    Spark takes sizes from compressed files and does not see what an explode adds, so a table of the size of the corpus can
    look small enough to broadcast.
    """
    return table if n is not None and n <= MOST_SENT else table.hint("merge")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_beaconlake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="beaconlake-")
    at = os.path.join(folder, "beaconlake_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._beaconlake_shipped = True


def slim() -> None:
    """Gives the memory that this process has freed back to the system, as far as its allocators let it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slimmed(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """run, a function for mapInArrow, that leaves a slim worker: workers outlive tasks and stages, beside the executor's heap."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            slim()

    return tidy


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row even if body has it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scans_files(docs: DataFrame) -> bool:
    """Whether docs is a selection from one scan of files, so that each row has a place of its own in them."""
    plan = docs._jdf.queryExecution().analyzed()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return kind == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def located(docs: DataFrame) -> DataFrame:
    """Two columns: doc, the input's row as one struct, and loc, a struct that names the row for good.

    All that an operator adds stands beside ``doc``, so no name of an input column can meet one of its own;
    ``select("doc.*")`` gives the row back. Selections from the struct are pruned down to the scan. The name of
    a row is the file it comes from and its place there; a frame that isn't a plain scan of files, or that hides
    these behind a column of its own, is first written to the shared folder.
    """
    whole = docs.select(F.struct("*").alias("doc"))
    hidden = any(c.lower() == "_metadata" for c in docs.columns)
    if hidden or not _scans_files(docs):
        whole = materialize(whole, "located")
        at = F.col("_metadata")
        place = F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))
        out = whole.select("doc", place.alias("loc"))
        out.scratch_path = whole.scratch_path
        return out
    place = F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.struct("*").alias("doc"), place.alias("loc"))


def of(name: str, struct: str = "doc") -> Column:
    """A column of the input's row, whatever signs its name has."""
    return F.col(struct).getField(name)


def row_name(doc_id: str) -> Column:
    """What orders rows for good: those with a doc_id first, by it, then by place."""
    return F.struct(of(doc_id).isNull().alias("unnamed"), of(doc_id).cast("long").alias("doc_id"), F.col("loc").alias("at"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def make_dir(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def open_shared(path: str, mode: str):
    """A binary file of the shared folder, from a Python worker: local and mounted folders, and what pyarrow reaches."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if "w" in mode else store.open_input_file(at)
