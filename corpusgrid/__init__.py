"""corpusgrid: a PySpark engine for document corpora."""
