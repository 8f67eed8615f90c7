"""Registered queries (Spark) and their DuckDB SQL oracles."""
