"""Spark jobs that watch HTTP API traffic for behavioural drift, and prepare training text."""
