"""Operators for training-data pipelines; each module states its contract in its docstring."""
