"""Operators that prepare text for training and retrieval. Nothing outside this folder imports it."""
