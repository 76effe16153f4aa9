"""Matching of public procurement notices to supplier profiles, on Spark."""
