"""A Spark-native engine that curates and scores transcript corpora."""
