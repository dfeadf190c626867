"""Operators of a training-data pipeline: DataFrames of documents in and out."""
