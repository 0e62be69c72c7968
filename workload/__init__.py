"""Checked queries: each runs an engine operator over the given tables, most with an equivalent DuckDB SQL."""
