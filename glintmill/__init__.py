"""A Spark engine for building, querying and measuring text retrieval."""
