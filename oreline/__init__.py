"""Spark-native medallion warehouse: landing tables, cleansed tables, star schema, checks."""
