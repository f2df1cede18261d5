"""All registered queries."""

from __future__ import annotations

from textwarden.plans import failures, inventory, scan, user_rules, watching
from textwarden.plans.registry import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (scan, user_rules, watching, failures, inventory):
        out.update(module.QUERIES)
    return out
