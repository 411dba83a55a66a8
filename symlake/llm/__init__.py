"""Operators over texts for training corpora. Nothing outside this folder imports it."""
