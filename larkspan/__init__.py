"""Span analytics on Spark: plant, detect, match, score and gate personal data in text."""
