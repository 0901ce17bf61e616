"""Spark-native analytics: validated query plans, ETL contracts, retrieval, rules and operations."""
