"""Annotation, event, document and embedding analytics as Spark DataFrame operators."""
