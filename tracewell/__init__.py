"""A PySpark-native column-lineage and data-processing engine."""

__version__ = "0.1.0"
