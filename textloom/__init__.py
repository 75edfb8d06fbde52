"""Corpus preparation, quality gates and corpus analytics as Spark DataFrame operators."""
