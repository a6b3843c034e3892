"""Claim analytics on Spark: document graphs, provenance queries and data preparation."""
