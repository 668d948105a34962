"""Grounded retrieval over clause-structured documents, planned by Spark."""
