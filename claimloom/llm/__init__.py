"""Operators for large training-data pipelines: one module each, plus their registered queries."""
