"""Incremental ingestion with the same results as the batch jobs."""
