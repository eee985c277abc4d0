"""Loomline: document retrieval, corpus ETL and learning analytics as Spark jobs."""
