"""Text-moderation analytics as Spark DataFrame jobs."""
