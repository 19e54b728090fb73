"""Trace search: span labels as parameters, and tag = value anywhere in q (or query) and tags."""

from __future__ import annotations

import re

from beaconlake.functions import labels
from beaconlake.plans import selectors
from beaconlake.plans.model import Matcher, Op, TracePlan, Window

REASON = "unsupported_selector"
_VALUE = r'\s*(?P<op>!=|=~|!~|=)\s*(?:"(?P<quoted>[^"]*)"|(?P<bare>[^\s,}&|"][^\s,}&|]*))'


def _found(text: str) -> list[Matcher]:
    """The first comparison of each spelling that stands on its own; other text is ignored."""
    out = []
    for spelling in labels.spellings(labels.SPANS):
        named = re.search(rf"(?<![A-Za-z0-9_.-]){re.escape(spelling)}(?=\s*(?:!=|=~|!~|=))", text)
        value = named and re.compile(_VALUE).match(text, named.end())
        if value:
            out.append(Matcher(spelling, Op(value["op"]), value["bare"] if value["quoted"] is None else value["quoted"]))
    return out


def parse(params: dict[str, str], window: Window, limit: int) -> TracePlan:
    matchers = [Matcher(s, Op.EQ, params[s]) for s in labels.spellings(labels.SPANS) if params.get(s)]
    for text in (params.get("q", params.get("query")), params.get("tags")):
        matchers += _found(text or "")
    return TracePlan(selectors.resolve(matchers, labels.SPANS, REASON), window, limit)
