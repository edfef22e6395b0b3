"""Sources: files, and paged JSON services through Spark's Python data source API."""
