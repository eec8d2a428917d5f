"""Spark-native analytics for one-photon calcium-imaging movies."""
