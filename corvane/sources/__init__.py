"""Readers and writers: parquet tables, hashed Markdown projections, change lists."""
