"""Batch jobs over source-code corpora, as DataFrame programs."""
