"""lakequill: retrieval, question answering and retrieval evaluation over a data lake, on Spark."""

__version__ = "0.1.0"
