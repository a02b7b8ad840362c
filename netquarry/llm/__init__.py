"""Operators for large-scale training-data pipelines. Nothing else in netquarry imports this package."""
