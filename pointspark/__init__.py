"""pointspark: point-cloud and training-data analytics expressed as Spark DataFrame plans."""
