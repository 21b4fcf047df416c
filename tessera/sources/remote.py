"""Settings for object stores and Iceberg catalogs. They are plain settings: nothing connects before a query does."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ObjectStore:
    """An S3-compatible store: ``ObjectStore.s3("http://host:9000").keys("id", "secret").scope("s3a://bucket")``."""

    endpoint: str | None = None
    region: str | None = None
    access: str | None = field(default=None, repr=False)
    secret: str | None = field(default=None, repr=False)
    prefix: str | None = None

    @classmethod
    def s3(cls, url: str) -> ObjectStore:
        if urlsplit(url).scheme not in ("http", "https"):
            raise ValueError("an endpoint is an http or https address")
        return cls(endpoint=url)

    @classmethod
    def aws(cls, region: str) -> ObjectStore:
        return cls(region=region)

    def keys(self, access: str, secret: str) -> ObjectStore:
        return replace(self, access=access, secret=secret)

    def scope(self, prefix: str) -> ObjectStore:
        if not prefix.startswith(("s3://", "s3a://")):
            raise ValueError("a scope begins with s3:// or s3a://")
        return replace(self, prefix=prefix)

    def settings(self) -> dict[str, str]:
        base = "fs.s3a."
        if self.prefix:
            base += f"bucket.{urlsplit(self.prefix).netloc}."
        out = {}
        if self.endpoint:
            out |= {f"{base}endpoint": self.endpoint, f"{base}path.style.access": "true", f"{base}connection.ssl.enabled": str(self.endpoint.startswith("https")).lower()}
        if self.region:
            out[f"{base}endpoint.region"] = self.region
        if self.access:
            out |= {f"{base}access.key": self.access, f"{base}secret.key": self.secret or ""}
        return out

    def apply(self, spark: SparkSession) -> None:
        conf = spark._jsc.hadoopConfiguration()
        for key, value in self.settings().items():
            conf.set(key, value)


@dataclass(frozen=True)
class IcebergCatalog:
    """A REST catalog. Its classes come with a jar that the session must have been started with."""

    name: str
    url: str
    warehouse_name: str | None = None
    bearer: str | None = field(default=None, repr=False)
    credential: str | None = field(default=None, repr=False)
    oauth_url: str | None = None
    tries: int | None = None

    @classmethod
    def rest(cls, url: str, name: str = "lake") -> IcebergCatalog:
        return cls(name, url.rstrip("/"))

    def warehouse(self, name: str) -> IcebergCatalog:
        return replace(self, warehouse_name=name)

    def token(self, token: str) -> IcebergCatalog:
        return replace(self, bearer=token, credential=None)

    def oauth2(self, client: str, secret: str, url: str | None = None) -> IcebergCatalog:
        return replace(self, credential=f"{client}:{secret}", oauth_url=url, bearer=None)

    def retries(self, tries: int) -> IcebergCatalog:
        return replace(self, tries=tries)

    def settings(self) -> dict[str, str]:
        base = f"spark.sql.catalog.{self.name}"
        out = {base: "org.apache.iceberg.spark.SparkCatalog", f"{base}.type": "rest", f"{base}.uri": self.url}
        for key, value in (("warehouse", self.warehouse_name), ("token", self.bearer), ("credential", self.credential), ("oauth2-server-uri", self.oauth_url)):
            if value:
                out[f"{base}.{key}"] = value
        if self.tries is not None:
            out[f"{base}.client.retry.max-attempts"] = str(self.tries)
        return out

    def apply(self, spark: SparkSession) -> None:
        for key, value in self.settings().items():
            spark.conf.set(key, value)

    def tidy(self, table: str, keep_days: int) -> list[str]:
        """The statements that merge small files, forget old snapshots and delete what nothing refers to."""
        return [
            f"CALL {self.name}.system.rewrite_data_files(table => '{table}')",
            f"CALL {self.name}.system.expire_snapshots(table => '{table}', older_than => current_timestamp() - INTERVAL {int(keep_days)} DAYS)",
            f"CALL {self.name}.system.remove_orphan_files(table => '{table}')",
        ]
