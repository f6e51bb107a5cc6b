"""Millrace: corpus preparation and analytics as Spark plans."""
