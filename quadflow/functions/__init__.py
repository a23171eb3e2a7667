"""quadflow.functions."""
