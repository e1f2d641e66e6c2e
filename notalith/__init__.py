"""Notalith: hybrid retrieval and text analytics as Spark plans."""
