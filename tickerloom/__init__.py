"""Quote-observation analytics as Spark DataFrame plans."""
