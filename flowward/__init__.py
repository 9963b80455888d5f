"""Network-flow threat analytics on Spark: scoring pipelines, dashboard queries, streaming and model training."""

__version__ = "0.1.0"
