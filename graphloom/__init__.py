"""graphloom: a PySpark engine for knowledge graphs, retrieval and corpus preparation."""

__version__ = "0.1.0"
