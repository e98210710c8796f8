"""Viewing analytics and similar-title recommendations as Spark DataFrame jobs."""
