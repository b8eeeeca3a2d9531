"""Match analytics as Spark DataFrame functions."""
