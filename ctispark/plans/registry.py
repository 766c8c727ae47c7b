"""Registered queries over the tables of a data folder, and the SQL each must agree with."""

from ctispark.plans import documents, extraction, functions, landed, more, tables

QUERIES = {**tables.QUERIES}
__all__ = ["ORACLE", "QUERIES", "documents", "extraction", "functions", "landed", "more"]
ORACLE = {**tables.ORACLE}
