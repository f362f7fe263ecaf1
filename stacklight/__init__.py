"""Stacklight: a PySpark-native analytics engine for catalogue enrichment, vector search and graph recommendation."""
