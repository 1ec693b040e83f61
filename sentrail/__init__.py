"""Fraud and phishing analytics as Spark jobs."""
