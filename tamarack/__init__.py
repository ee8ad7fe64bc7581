"""Spark-native engine for preparing, auditing and scoring transcribed-speech corpora."""
