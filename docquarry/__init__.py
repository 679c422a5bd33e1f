"""Spark-native document analytics: search, facets, extraction, graphs and corpus preparation."""
