"""Registered queries of the library's own operators, by family."""

from . import evaluation, lexicons, linkage, readers, scalars, streams, trajectories

FAMILIES = (trajectories, lexicons, linkage, scalars, readers, evaluation, streams)
QUERIES = {name: q for f in FAMILIES for name, q in f.QUERIES.items()}
ORACLE_SQL = {name: sql for f in FAMILIES for name, sql in f.ORACLE_SQL.items()}
