"""Registered queries over the shared test tables, each with its SQL counterpart where SQL can say it."""

from queries import answers, facts, text, topics

_MODULES = (facts, text, answers, topics)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
