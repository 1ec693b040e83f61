"""Structured Streaming jobs over sightings, reports and requests."""
