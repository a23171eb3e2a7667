"""quadflow.operators."""
