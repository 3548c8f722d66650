"""Operators for corpora of training documents. Nothing outside this folder imports it."""
