"""Batch jobs on Spark that build, refresh and query document-search indexes."""
