"""All named queries: name -> (function of session and table folder, SQL of the same result or None)."""

from __future__ import annotations

import importlib

MODULES = ["messages", "reports", "attachments", "text", "sinks", "streams"]


def catalog() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        module = importlib.import_module(f"postmill.plans.queries_{name}")
        out.update(module.Q)
    return out
