"""Metric operators: ``op(frames..., column names..., params...) -> DataFrame``."""
