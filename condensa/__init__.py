"""Text compression and analytics over large collections, as Spark jobs."""
