"""Graph, retrieval and ingestion analytics on Spark DataFrames."""
