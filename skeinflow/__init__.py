"""Movement-evidence analytics as Spark DataFrame operators."""
