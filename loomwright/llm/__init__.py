"""Training-data operators: tokenisation, formatting, filtering and deduplication on Spark."""
