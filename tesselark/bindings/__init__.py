"""Registered queries over the test tables."""

from . import graphs, knowledge, relational

MODULES = [relational, graphs, knowledge]
QUERIES = {k: v for m in MODULES for k, v in m.Q.items()}
ORACLES = {k: v for m in MODULES for k, v in m.O.items()}
