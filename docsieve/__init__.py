"""Search, count and edit large document collections held in Spark tables."""
