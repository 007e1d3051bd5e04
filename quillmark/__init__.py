"""Spark-native analytics over company filings, statements and market data."""
