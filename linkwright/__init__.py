"""Spark-native probabilistic record linkage between two registries that share no identifier."""
