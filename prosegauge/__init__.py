"""Prose measurement on Spark: deterministic features, references, flags and control charts over DataFrames of documents."""
