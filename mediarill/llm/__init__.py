"""Operators for training-data pipelines. Nothing outside imports this package."""
