"""All queries of this subpackage, with their SQL."""

from __future__ import annotations

from codeloom.llm import distinctive, generated, leximin, mix, pack, secrets, split, syntax, toxic

_MODULES = (split, syntax, generated, secrets, leximin, distinctive, pack, mix, toxic)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
