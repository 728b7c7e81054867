"""opinara: review-sentiment analytics as PySpark DataFrame operators."""
