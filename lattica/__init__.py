"""Lattica: a Spark-native engine for weighted concept graphs and the text data derived from them."""
