"""Operators for training-data pipelines, one module each."""
