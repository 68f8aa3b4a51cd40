"""Part of the retrieval and usage-analytics library."""
