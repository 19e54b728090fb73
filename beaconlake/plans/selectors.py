"""Selectors: name, name{label="value",...} and {label="value",...}."""

from __future__ import annotations

import re

from beaconlake.functions import labels
from beaconlake.plans.model import ApiError, Matcher, Op

_NAME = re.compile(r"[A-Za-z0-9_:.]+")
#: Tried in this order, anywhere in a part.
_OPS = (Op.NOT_RE, Op.RE, Op.NE, Op.EQ)


def bad(reason: str, message: str) -> ApiError:
    return ApiError(400, reason, message)


def unquote(text: str) -> str:
    """Without white space and all double quotes around it; escapes stay."""
    return text.strip().strip('"')


def _parts(text: str, reason: str) -> list[str]:
    """Splits at commas outside of double quotes."""
    parts, quoted, skip = [""], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            parts.append("")
            continue
        parts[-1] += c
    if quoted:
        raise bad(reason, "a quoted label value does not end")
    return parts


def parse(text: str, reason: str) -> tuple[str, list[Matcher]]:
    """The name before the braces, and the matchers as they are written."""
    text = text.strip()
    name, brace, inner = text.partition("{")
    if not brace:
        if not _NAME.fullmatch(text):
            raise bad(reason, 'a selector is name, name{label="value"}, or {label="value"}')
        return text, []
    if not inner.endswith("}"):
        raise bad("invalid_selector", "a selector must end with }")
    found = []
    for part in filter(None, map(str.strip, _parts(inner[:-1], reason))):
        op = next((o for o in _OPS if o.value in part), None)
        if op is None:
            raise bad(reason, "a label filter needs =, !=, =~, or !~")
        key, _, value = part.partition(op.value)
        found.append(Matcher(key.strip(), op, unquote(value)))
    return name.strip(), found


def _check_pattern(pattern: str, reason: str) -> None:
    """Rejects what linear-time engines do not have and this one would run: look-around, back references, possessive repeats."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern) or re.search(r"(?<!\\)[*+?}]\+", pattern):
        raise bad(reason, f"pattern {pattern!r} uses look-around, back references, or possessive repeats")
    try:
        re.compile(pattern)
    except re.error as error:
        if "unknown extension" not in str(error) and "bad escape" not in str(error):
            raise bad(reason, f"pattern {pattern!r}: {error}") from None


def resolve(matchers: list[Matcher], scope: str, reason: str) -> tuple[Matcher, ...]:
    """Matchers on the registry's names. Two different values for one label fail instead of matching nothing."""
    equal: dict[str, str] = {}
    out = []
    for m in matchers:
        name = labels.canonical(scope, m.field)
        if name is None:
            raise bad(reason, f"label {m.field} is not supported here")
        if m.op is Op.EQ and equal.setdefault(name, m.value) != m.value:
            raise bad(reason, f"label {name} is asked for with two values")
        if m.op in (Op.RE, Op.NOT_RE):
            _check_pattern(m.value, reason)
        out.append(Matcher(name, m.op, m.value))
    return tuple(out)
