"""Operators for training-data pipelines over fixture contents, request messages and boards."""
