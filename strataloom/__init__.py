"""Spark-native program-graph analytics: typed node and edge tables, graph, spectral and evidence operators."""
