"""Tidemark: incremental SQL pipelines and table operators on PySpark."""

__version__ = "0.1.0"
