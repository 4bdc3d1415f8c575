"""Atrium: indoor-venue analytics expressed as Spark DataFrame jobs."""
