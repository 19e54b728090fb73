"""Log lines as key=value pairs."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


def pair(key: str, value: object) -> str:
    text = str(value)
    plain = text and not any(c in ' ="\\' or not c.isprintable() for c in text)
    return f"{key}={text if plain else json.dumps(text, ensure_ascii=False)}"


class Logfmt(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        pairs = [("ts", at), ("level", record.levelname.lower()), ("logger", record.name), ("msg", record.getMessage())]
        pairs += getattr(record, "fields", {}).items()
        if record.exc_info:
            pairs.append(("error", repr(record.exc_info[1])))
        return " ".join(pair(k, v) for k, v in pairs)


def setup(level: str = "INFO") -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(Logfmt())
    logging.basicConfig(level=level.upper(), handlers=[handler], force=True)
