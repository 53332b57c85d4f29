"""Operators for large text corpora: ten stand-alone components and their queries.

Nothing outside this subpackage imports it.  Each module documents the
defined result for nulls, empty texts, ties, repeated rows and empty tables.
"""
