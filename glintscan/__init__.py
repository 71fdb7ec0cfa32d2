"""Secret and indicator analytics over large file collections, on Spark."""
