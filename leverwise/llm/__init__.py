"""Operators that prepare text and vectors for the training of language models."""
