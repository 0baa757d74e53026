"""tracksift: evaluation analytics over label tracks and model responses on Spark."""

__version__ = "0.1.0"
