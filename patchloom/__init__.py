"""Spark operators for code corpora: chunk, prompt, patch, validate, track."""
