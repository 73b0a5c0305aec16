"""Column lineage, metric definitions and relational operators for Spark SQL."""

__version__ = "0.1.0"
