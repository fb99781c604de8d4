"""Training-data operators: filtering, deduplication, tokenisation and archives on Spark."""
