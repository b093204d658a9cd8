"""Whole jobs: several operators and their reads and writes, in the order they must run."""
