"""ledgerloom: a PySpark engine for large directed transaction graphs."""

__version__ = "0.1.0"
