"""Operators for training-data pipelines at scale. Nothing else in the package imports this one."""
