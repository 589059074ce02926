"""Batch and streaming Spark jobs for log investigation."""
