"""Text preparation and catalog analytics on Spark."""
