"""Operators for text corpora used in training language models."""
