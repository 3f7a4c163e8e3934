"""Document-verification analytics on Spark: every stage is a DataFrame-to-DataFrame function."""
