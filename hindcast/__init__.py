"""Honest predictive tasks from relational event tables, as Spark jobs."""
