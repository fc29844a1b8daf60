"""Every query of the library by name, with its SQL twin where there is one."""

from . import evaluation_queries, feature_queries, relational_queries, window_queries

_PARTS = (window_queries, evaluation_queries, feature_queries, relational_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
