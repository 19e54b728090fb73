"""python -m beaconlake.server.cli serve | healthcheck"""

from __future__ import annotations

import argparse
import logging
import signal
import ssl
import sys
import threading
import urllib.error
import urllib.request

from pyspark.sql import SparkSession

from beaconlake.plans.schema import SchemaError
from beaconlake.server import config as settings
from beaconlake.server import log
from beaconlake.server.http import App, Server
from beaconlake.sources import meta
from beaconlake.sources.tables import ParquetTables


def serve(path: str | None) -> int:
    log.setup()
    config = settings.load(path)
    spark = (
        SparkSession.builder.appName("beaconlake").config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    app = App(spark, config)
    if isinstance(app.tables, ParquetTables):
        app.tables.create_missing()
        meta.stamp(spark, app.tables.root)
    server = Server(app)
    for sign in (signal.SIGINT, signal.SIGTERM):
        signal.signal(sign, lambda *_: threading.Thread(target=server.drain).start())
    logging.getLogger("beaconlake").info("listening", extra={"fields": {"bind": config.bind, "tls": config.tls_enabled}})
    server.serve_forever(poll_interval=0.1)
    return 0


def healthcheck(url: str, timeout: float, insecure: bool) -> int:
    """0 if /healthz says ok."""
    context = ssl.create_default_context()
    if insecure:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    try:
        with urllib.request.urlopen(url.rstrip("/") + "/healthz", timeout=timeout, context=context if url.startswith("https") else None) as answer:
            return 0 if answer.status == 200 else 1
    except (urllib.error.URLError, OSError) as error:
        print(f"not healthy: {error}", file=sys.stderr)
        return 1


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="beaconlake")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("serve")
    run.add_argument("--config")
    check = commands.add_parser("healthcheck")
    check.add_argument("--url", default="http://127.0.0.1:9090")
    check.add_argument("--timeout", type=float, default=2.0)
    check.add_argument("--insecure", action="store_true")
    got = parser.parse_args(args)
    try:
        return serve(got.config) if got.command == "serve" else healthcheck(got.url, got.timeout, got.insecure)
    except (settings.ConfigError, SchemaError) as error:
        print(f"settings: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
