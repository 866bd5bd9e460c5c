"""Lodestone: a Spark-native context engine (ingest, link, search, rank, pack, evaluate)."""
