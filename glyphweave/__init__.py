"""glyphweave: a Spark-first engine for document structure, layout tables and semantic graphs."""

__version__ = "0.1.0"
