"""Queries over the given tables, one per operator, with the SQL they must agree with."""

from panelspark.catalog import boosting_queries, cleaning_queries, feature_queries, model_queries, panel_queries, ranking_queries

_REGISTRIES = [m.R for m in (cleaning_queries, panel_queries, feature_queries, ranking_queries, model_queries, boosting_queries)]
QUERIES = {name: fn for r in _REGISTRIES for name, fn in r.queries.items()}
ORACLE_SQL = {name: sql for r in _REGISTRIES for name, sql in r.sql.items()}
