"""Corvane: Spark-native curation, grounding and evaluation of report-style corpora."""
