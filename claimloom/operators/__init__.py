"""Operators on facts, claims, blocks and links: DataFrame in, DataFrame out."""
