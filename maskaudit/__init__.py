"""Evaluate, audit and report binary pixel scorers as lazy Spark jobs."""

__version__ = "0.1.0"
