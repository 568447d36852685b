"""Web-corpus ingestion, extraction and job analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
