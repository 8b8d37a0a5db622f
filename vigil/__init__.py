"""Surveillance analytics on Spark: DataFrame operators over report archives, series and places."""
