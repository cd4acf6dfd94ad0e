"""All queries of the library's own operators, with the SQL that checks them."""

from importlib import import_module

#: Modules with QUERIES and ORACLES.
MODULES: list[str] = ["plans.q_urls", "plans.q_stats", "plans.q_graph", "plans.q_extract", "plans.q_openapi", "plans.q_sites", "plans.q_policy"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"pagegraph.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
