"""Certified catalog enrichment on Spark: extraction, verification, scoring and certification."""
