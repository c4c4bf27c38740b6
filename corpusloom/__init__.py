"""Crawl-frontier, corpus-manifest and training-data analytics on PySpark."""
