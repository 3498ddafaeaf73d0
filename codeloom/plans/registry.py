"""All queries of the core, with their SQL."""

from __future__ import annotations

from codeloom.plans import code, incremental, projects, reports, scanning, search
from codeloom.streaming import push

_MODULES = (incremental, scanning, search, projects, code, reports, push)
FLAGSHIP = "bm25_topk"
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
