"""Runnable jobs: each reads tables by path, writes partitioned Parquet and can be run again at any time."""
