"""Embedding analytics on Spark: similarity, clustering, projection and routing as DataFrame plans."""
