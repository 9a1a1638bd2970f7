"""Snapshot-catalog analytics as DataFrame operators for Apache Spark."""
