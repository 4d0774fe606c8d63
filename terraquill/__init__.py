"""Image-annotation analytics on Spark."""
