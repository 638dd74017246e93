"""Spark-native curation, linking, auditing and analysis of an event ledger."""
