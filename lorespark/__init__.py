"""Knowledge-base analytics as PySpark DataFrame functions."""
