"""Operators for preparing language-model training data; no other package imports this one."""
