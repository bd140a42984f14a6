"""Analytics and corpus-preparation operators as Spark jobs."""
