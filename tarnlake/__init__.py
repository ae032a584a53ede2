"""Tarnlake: session-record ingest, credential scanning, search and retention rules as Spark DataFrames."""
