"""Classical text retrieval and collection analytics as Spark DataFrame plans."""
