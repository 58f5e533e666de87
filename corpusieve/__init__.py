"""Spark-native document triage, retrieval and corpus preparation."""
