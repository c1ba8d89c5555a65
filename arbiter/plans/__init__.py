"""Bindings of operators to the driver tables, and their SQL oracles."""
