"""Spark-first analytics over agent trajectories, verdicts and preference pairs."""

__version__ = "0.1.0"
