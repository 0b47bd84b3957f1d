"""Spark-native factor-panel analytics on a long ``(date, ticker)`` table."""
