"""Spark-native analytics over document corpora and the claims drawn from them."""
