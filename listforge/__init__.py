"""Listforge: a PySpark-native engine for short-lived listings."""
