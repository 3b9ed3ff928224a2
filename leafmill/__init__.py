"""Document analytics and training-data processing as Spark DataFrame programs."""
