"""All registered queries in one place."""

from __future__ import annotations

from recquarry.plans import cleaning, evaluation, merging, sequencing, texts, vectoring

QUERIES: dict = {}
SQL: dict = {}
for _module in (cleaning, sequencing, texts, vectoring, evaluation, merging):
    for _name in _module.R.queries:
        if _name in QUERIES:
            raise ValueError(f"duplicate query {_name}")
    QUERIES.update(_module.R.queries)
    SQL.update(_module.R.sql)
