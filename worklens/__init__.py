"""Session-log analytics on Spark: transcripts, sessions, cost, privacy gates, citations, clusters and actions."""
