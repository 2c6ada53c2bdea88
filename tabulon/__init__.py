"""Record analytics expressed as DataFrame -> DataFrame operators on Spark."""
