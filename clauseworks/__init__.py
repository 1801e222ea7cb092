"""A PySpark engine for hybrid search over hierarchical text corpora."""
