"""Content-based rating prediction as set-based Spark jobs."""
