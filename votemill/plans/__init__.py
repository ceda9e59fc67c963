"""Named queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from votemill.plans import registry

for _name in ("voting", "evaluation", "corpus", "texts", "systems", "contracts", "resampling", "selection", "streams", "files"):
    importlib.import_module(f"votemill.plans.{_name}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
