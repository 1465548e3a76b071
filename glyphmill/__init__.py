"""Spark-first analytics for text-recognition runs: latency, accuracy, geometry and streams."""
