"""Threat-intelligence analytics as Spark DataFrame jobs."""
