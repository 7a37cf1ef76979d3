"""Marlstone: knowledge-retrieval analytics as DataFrame and SQL plans on Spark."""

__version__ = "0.1.0"
