"""Operators over texts and names for training data. Nothing outside this folder imports it."""
