"""Dense retrieval and vector analytics as PySpark DataFrame programs."""
