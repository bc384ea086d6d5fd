"""Pure functions from bytes to rows. None of them imports Spark; all of them are bounded by Limits."""
