"""Operators of a training-data pipeline (sharding, filtering, dedup, search, packing).

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries and ``oracles`` their DuckDB SQL.
"""
