"""turnloom: Spark-native analytics over long multi-agent run transcripts."""

__version__ = "0.1.0"
