"""Text-evidence analytics as Spark DataFrame operators."""
