"""Catalogue analytics on Spark: cleaning, matching, merging and profiling of bibliographic records."""
