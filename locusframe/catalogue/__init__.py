"""Queries over the driver's tables, grouped as the operators are, each beside the DuckDB SQL that must give its rows."""
