"""reviewlake — product-catalogue and customer-review analytics on Spark.

Subpackages:
  sources    declared-schema readers, page/sitemap/JSON extraction, writers
  functions  column expressions (URLs, money, tags, text cleaning, tokens)
  operators  catalogue, trait profiles, dashboards, ingest state, tf-idf,
             recommendations, sentiment, topics
  streaming  Structured Streaming forms of the incremental jobs
  plans      named queries over the test tables and their DuckDB twins
"""

__version__ = "0.1.0"
