"""Spark-native building of text corpora from wiki dumps and linked data."""
