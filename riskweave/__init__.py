"""riskweave: Spark-native analytics over AI-application security findings."""

__version__ = "0.1.0"
