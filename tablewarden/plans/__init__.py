"""Datasets, pipelines and the query registry."""
