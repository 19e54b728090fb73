"""A trace as protobuf bytes, by the public OTLP trace messages."""

from __future__ import annotations

import struct
from collections.abc import Iterable


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n) if n else b""


def fixed64(field: int, n: int) -> bytes:
    return varint(field << 3 | 1) + struct.pack("<Q", n & (1 << 64) - 1) if n else b""


def data(field: int, value: bytes | str, always: bool = False) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return varint(field << 3 | 2) + varint(len(raw)) + raw if raw or always else b""


def _attribute(field: int, key: str, value: str | int | None) -> bytes:
    if value is None or value == "":
        return b""
    any_value = varint(3 << 3) + varint(value) if isinstance(value, int) else data(1, value)
    return data(field, data(1, key) + data(2, any_value, True))


def _id(text: str | None) -> bytes:
    try:
        return bytes.fromhex(text or "")
    except ValueError:
        return b""


def span(row: dict, start_nanos: int) -> bytes:
    """Empty fields are left out; a negative duration counts as none; a status is 0, 1 or 2."""
    status = row["status_code"] if row["status_code"] in (1, 2) else 0
    return b"".join([
        data(1, _id(row["trace_id"])), data(2, _id(row["span_id"])), data(3, row["trace_state"] or ""), data(4, _id(row["parent_span_id"])),
        data(5, row["span_name"] or ""), number(6, row["span_kind"] or 0),
        fixed64(7, start_nanos), fixed64(8, start_nanos + max(0, row["duration"] or 0)),
        _attribute(9, "service.name", row["service_name"]), _attribute(9, "http.request.method", row["http_method"]),
        _attribute(9, "http.response.status_code", row["http_status_code"]), _attribute(9, "http.route", row["http_route"]),
        _attribute(9, "exception.type", row["exception_type"]),
        data(15, data(2, row["status_message"] or "") + number(3, status), True),
    ])


def trace(rows: Iterable[tuple[dict, int]]) -> bytes:
    """A response with one resource and one scope; each of their fields is from the first span that has it."""
    rows = list(rows)
    first = lambda key: next((r[key] for r, _ in rows if r[key]), "")
    resource = _attribute(1, "service.name", first("service_name")) + _attribute(1, "deployment.environment", first("deployment_environment"))
    scope = data(1, first("scope_name")) + data(2, first("scope_version"))
    spans = data(1, scope, True) + b"".join(data(2, span(r, at), True) for r, at in rows)
    return data(1, data(1, data(1, resource, True) + data(2, spans, True), True), True)
