"""Tender-to-catalog matching and bid analytics as Spark DataFrame jobs."""
