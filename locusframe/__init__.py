"""Spark-native sequence-similarity and neighbourhood analytics."""
