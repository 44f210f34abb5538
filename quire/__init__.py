"""Quire: document-structure and operational analytics as Spark jobs."""
