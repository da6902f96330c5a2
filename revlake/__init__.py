"""Revision-aware file and document analytics on Spark: operators from DataFrame to DataFrame."""
