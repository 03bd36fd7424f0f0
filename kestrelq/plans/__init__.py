"""Named queries and their oracle SQL, gathered from the modules beside this one."""

from __future__ import annotations

from kestrelq.plans import iterative, relational, scalar, stateful, tables, temporal

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (relational, scalar, temporal, iterative, stateful, tables):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
