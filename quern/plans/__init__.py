"""Pipelines: each takes DataFrames and returns a Stage (rows with a reason, null for kept)."""
