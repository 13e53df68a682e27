"""Operators for large text corpora and embedding tables.

Nothing outside this folder imports it, so it can be left out of a build.
"""
