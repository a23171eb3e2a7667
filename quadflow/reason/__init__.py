"""quadflow.reason."""
