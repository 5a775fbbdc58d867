"""A Spark-first engine for indexing and searching collections of text and source files."""
