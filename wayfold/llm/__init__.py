"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage. Every operator works on
plain DataFrames, keeps unbounded groups off single tasks and off the driver,
and cuts lineage only with reliable checkpoints in the shared checkpoint folder.
"""
