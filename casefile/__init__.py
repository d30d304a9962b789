"""Forensic analytics as Spark DataFrame operators."""
