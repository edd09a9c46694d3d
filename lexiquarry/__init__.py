"""A full-text retrieval and text-analytics engine on PySpark."""
