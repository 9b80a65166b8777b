"""Spark-native analytics for paired-measurement experiments and training-data preparation."""
