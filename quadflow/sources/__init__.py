"""quadflow.sources."""
