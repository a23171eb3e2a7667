"""quadflow.streaming."""
