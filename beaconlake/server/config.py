"""Settings: environment over TOML file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from beaconlake.sources.catalogs import CatalogError, CatalogSettings, plan

PREFIX = "BEACONLAKE_"


class ConfigError(Exception):
    pass


@dataclass(frozen=True)
class Config:
    bind: str = "127.0.0.1:9090"
    data_dir: str = "data"
    api_key: str = "dev-beaconlake-key"
    admin_api_key: str = "dev-beaconlake-admin-key"
    tls_enabled: bool = False
    tls_cert_file: str | None = None
    tls_key_file: str | None = None
    max_body_bytes: int = 8 << 20
    max_connections: int = 1024
    socket_read_timeout_secs: int = 30
    socket_write_timeout_secs: int = 30
    query_concurrency: int = 4
    query_timeout_secs: int = 15
    query_admission_wait_ms: int = 1000
    cheap_query_capacity: int = 1
    catalog: CatalogSettings = field(default_factory=CatalogSettings)

    @property
    def tables_dir(self) -> str:
        return f"{self.data_dir}/tables"

    def check(self) -> Config:
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ConfigError(message)

        need(bool(self.api_key.strip()), "api_key is empty")
        need(bool(self.admin_api_key.strip()), "admin_api_key is empty")
        need(self.api_key != self.admin_api_key, "api_key and admin_api_key are the same, which opens the admin routes")
        host, _, port = self.bind.rpartition(":")
        need(bool(host) and port.isdigit() and int(port) < 1 << 16, f"bind is host:port, not {self.bind!r}")
        if self.tls_enabled:
            need(bool(self.tls_cert_file), "TLS needs tls_cert_file")
            need(bool(self.tls_key_file), "TLS needs tls_key_file")
        for name in ("max_body_bytes", "max_connections", "socket_read_timeout_secs", "socket_write_timeout_secs", "query_concurrency", "query_timeout_secs", "cheap_query_capacity"):
            need(getattr(self, name) > 0, f"{name} must be above 0")
        need(self.query_admission_wait_ms >= 0, "query_admission_wait_ms must not be negative")
        need(self.query_concurrency > self.cheap_query_capacity, "query_concurrency leaves no slot for heavy queries")
        try:
            plan(self.catalog, self.tables_dir)
        except CatalogError as error:
            raise ConfigError(str(error)) from None
        return self


def _typed(name: str, kind: str, raw: object) -> object:
    if kind == "bool":
        text = str(raw).strip().lower()
        if text in ("1", "true", "yes", "on"):
            return True
        if text in ("0", "false", "no", "off"):
            return False
        raise ConfigError(f"{name} is not a truth value: {raw!r}")
    if kind == "int":
        try:
            if isinstance(raw, (bool, float)):
                raise ValueError
            return int(str(raw).strip())
        except ValueError:
            raise ConfigError(f"{name} is not a whole number: {raw!r}") from None
    if not isinstance(raw, str):
        raise ConfigError(f"{name} is not text: {raw!r}")
    return raw


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The file has a setting at the top or in any section: query_timeout_secs, or timeout_secs under [query]."""
    env = dict(os.environ) if env is None else env
    given: dict[str, object] = {}
    path = path or env.get(PREFIX + "CONFIG")
    if path:
        try:
            with open(path, "rb") as file:
                raw = tomllib.load(file)
        except (OSError, tomllib.TOMLDecodeError) as error:
            raise ConfigError(f"{path}: {error}") from None

        def flatten(table: dict, at: str) -> None:
            for k, v in table.items():
                flatten(v, f"{at}{k}_") if isinstance(v, dict) else given.__setitem__(at + k, v)

        flatten(raw, "")
    own = {f.name: str(f.type) for f in fields(Config) if f.name != "catalog"}
    catalog = {f"catalog_{f.name}" if f.name != "catalog_path" else "catalog_path": (f.name, str(f.type)) for f in fields(CatalogSettings)}
    unknown = set(given) - set(own) - set(catalog)
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    given |= {k: env[PREFIX + k.upper()] for k in (*own, *catalog) if PREFIX + k.upper() in env}
    values = {k: _typed(k, own[k].removesuffix(" | None"), v) for k, v in given.items() if k in own}
    parts = {catalog[k][0]: _typed(k, catalog[k][1].removesuffix(" | None"), v) for k, v in given.items() if k in catalog}
    return Config(**values, catalog=CatalogSettings(**parts)).check()
