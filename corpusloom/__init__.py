"""Spark-first engine for curating text corpora and evaluating structured model outputs."""
