"""Composed jobs (EDA bundle, feature job, training jobs) and the registered
queries with their DuckDB oracle SQL."""
