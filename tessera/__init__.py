"""Cutoff-aware analytics over ordered text and event data, on Spark."""
