"""Shelfmark: a PySpark-native analytics engine for media-catalogue data."""
