"""Cairn: a PySpark-native media catalogue and content-addressed analytics engine."""
