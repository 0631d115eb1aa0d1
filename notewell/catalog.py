"""All queries over the reference tables, with the SQL that must give the same rows."""

from __future__ import annotations

from notewell.queries import canonical, carried, distill, links, lint, logs, reading, scalars, search, sections, structure, views

MODULES = (views, links, lint, sections, search, logs, reading, distill, scalars, structure, canonical, carried)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
