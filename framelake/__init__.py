"""Spark-first analytics for camera recordings, annotations and vectors."""
