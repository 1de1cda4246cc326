"""Statements an independent engine runs to check the Spark results."""
