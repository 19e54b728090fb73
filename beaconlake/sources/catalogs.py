"""Catalog kinds: which settings go together, and how each is read."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.plans import schema
from beaconlake.sources.tables import ParquetTables, Tables


class CatalogError(Exception):
    pass


@dataclass(frozen=True)
class CatalogSettings:
    """postgres_dsn, attach_uri and catalog_path name three kinds of catalog; one of them at most."""

    postgres_dsn: str | None = None
    attach_uri: str | None = None
    catalog_path: str | None = None
    data_path: str | None = None
    token: str | None = None
    insecure_tls: bool = False


@dataclass(frozen=True)
class CatalogPlan:
    mode: str
    data_path: str | None
    object_store: str | None
    location: str


def object_store(path: str) -> str | None:
    """s3 or gcs, by the scheme of a path; None for local and other paths."""
    scheme = path.strip().lower().partition("://")[0] if "://" in path else ""
    return {"s3": "s3", "s3a": "s3", "gcs": "gcs", "gs": "gcs"}.get(scheme)


def hadoop_path(path: str) -> str:
    """The same path under the scheme that Hadoop's file systems go by."""
    kind = object_store(path)
    if not kind:
        return path
    return f"{'s3a' if kind == 's3' else 'gs'}://" + path.strip().partition("://")[2]


def region(env: dict[str, str] | None = None) -> str | None:
    env = os.environ if env is None else env
    names = ("BEACONLAKE_OBJECT_STORE_REGION", "AWS_REGION", "AWS_DEFAULT_REGION")
    return next((env[n].strip() for n in names if env.get(n, "").strip()), None)


def use_object_store(spark: SparkSession, kind: str, at: str | None = None) -> None:
    """Ambient credentials for s3a or gs; no keys are kept in settings."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if kind == "s3":
        conf.set("fs.s3a.aws.credentials.provider", "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider")
        if at:
            conf.set("fs.s3a.endpoint.region", at)
    else:
        conf.set("google.cloud.auth.type", "APPLICATION_DEFAULT")


def plan(settings: CatalogSettings, default_path: str) -> CatalogPlan:
    """Checks that the settings agree and says which catalog they mean."""
    s = settings
    data = (s.data_path or "").strip() or None
    if s.postgres_dsn is not None and s.attach_uri is not None:
        raise CatalogError("set a Postgres DSN or an attach URI, not both")
    if s.catalog_path is not None and (s.postgres_dsn is not None or s.attach_uri is not None):
        raise CatalogError("a catalog path is for the local catalog only")
    store = object_store(data) if data else None
    uri = None if s.attach_uri is None else s.attach_uri.strip()
    quack = uri is not None and uri.startswith("ducklake:quack:")
    if s.insecure_tls and not quack:
        raise CatalogError("insecure TLS has no effect without a ducklake:quack: URI")
    if uri is not None:
        if not uri:
            raise CatalogError("the attach URI is empty")
        if uri.upper().startswith("ATTACH "):
            raise CatalogError("give the URI alone, not an ATTACH statement")
        if not uri.startswith(("md:", "ducklake:")):
            raise CatalogError("an attach URI starts with md: or ducklake:")
        if quack and not (s.token or "").strip():
            raise CatalogError("a ducklake:quack: URI needs a token")
        if uri.startswith("md:"):
            if data:
                raise CatalogError("a data path cannot be set with an md: URI")
            return CatalogPlan("remote", None, None, uri)
        return CatalogPlan("custom_uri", data, store, uri)
    if s.postgres_dsn is not None:
        if not s.postgres_dsn.strip():
            raise CatalogError("the Postgres DSN is empty")
        return CatalogPlan("postgres", data or default_path, store, s.postgres_dsn)
    return CatalogPlan("local", data or default_path, store, s.catalog_path or default_path)


def attach(spark: SparkSession, settings: CatalogSettings, default_path: str) -> Tables:
    """Tables of the catalog. Catalogs behind vendor protocols have no open reader and are refused."""
    p = plan(settings, default_path)
    if p.object_store:
        use_object_store(spark, p.object_store, region())
    if p.mode == "local":
        return ParquetTables(spark, hadoop_path(p.data_path))
    if p.mode == "postgres":
        return CatalogTables(spark, postgres_metadata(spark, p.location), hadoop_path(p.data_path))
    raise CatalogError(f"no open connector reads {p.location.partition(':')[0]}: catalogs; use Parquet or a Postgres catalog")


def postgres_metadata(spark: SparkSession, dsn: str):
    """Reads the catalog's own tables over JDBC; needs a Postgres driver on the class path."""
    url = dsn if dsn.startswith("jdbc:") else "jdbc:postgresql://" + dsn.partition("://")[2] if "://" in dsn else "jdbc:postgresql:" + dsn
    return lambda name: spark.read.format("jdbc").option("url", url).option("dbtable", name).option("driver", "org.postgresql.Driver").load()


class CatalogTables(Tables):
    """Tables whose live files are listed in a catalog: metadata(name) gives ducklake_table and ducklake_data_file."""

    def __init__(self, spark: SparkSession, metadata, root: str) -> None:
        super().__init__(spark)
        self.metadata, self.root = metadata, root.rstrip("/")

    def live_files(self, name: str) -> list[str]:
        """Paths of the table's live files; a file list is what any Parquet scan keeps on the driver.

        Refused are tables with rows deleted by files, which would come back, and with paths relative to folders of
        schemas or tables, which are not followed.
        """
        t = self.metadata("ducklake_table").filter(F.col("end_snapshot").isNull() & (F.col("table_name") == name))
        f = self.metadata("ducklake_data_file").filter(F.col("end_snapshot").isNull()).join(t.select("table_id"), "table_id", "left_semi")
        if "path_is_relative" in t.columns and not t.filter(F.col("path_is_relative") & F.col("path").isNotNull() & (F.col("path") != "")).isEmpty():
            raise CatalogError(f"{name} keeps its files relative to a folder of its own, which is not read")
        if "delete_count" in f.columns and not f.filter("delete_count > 0").isEmpty():
            raise CatalogError(f"{name} has deleted rows in its files, which are not read")
        deletes = self.deletes()
        if deletes is not None:
            live = deletes.filter(F.col("end_snapshot").isNull()).join(t.select("table_id"), "table_id", "left_semi")
            if not live.isEmpty():
                raise CatalogError(f"{name} has delete files, which are not read")
        return [p if "://" in p or p.startswith("/") else f"{self.root}/{p}" for p in (r["path"] for r in f.select("path").collect())]

    def deletes(self) -> DataFrame | None:
        """The catalog's list of delete files; None for metadata without one."""
        try:
            return self.metadata("ducklake_delete_file")
        except KeyError:
            return None

    def table(self, name: str) -> DataFrame:
        files = self.live_files(name)
        return schema.conform(self.spark.read.parquet(*files), name) if files else self.empty(name)


def storage_layout(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Live files and their rows by live table, tables without files included."""
    t = tables.filter(F.col("end_snapshot").isNull()).select("table_id", "table_name")
    f = files.filter(F.col("end_snapshot").isNull()).select(F.col("table_id").alias("of"), "data_file_id", "record_count")
    return t.join(f, t["table_id"] == f["of"], "left").groupBy("table_id", "table_name").agg(
        F.count("data_file_id").alias("active_data_files"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("active_data_file_rows"),
    )
