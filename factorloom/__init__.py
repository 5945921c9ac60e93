"""Point-in-time factor research on Spark: panels, labels, scores, metrics and inference."""
