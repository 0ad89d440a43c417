"""Expressions: impurities, gains and centroids as columns and as array operations."""
