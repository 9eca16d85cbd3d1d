"""Evidence analytics on Spark: deterministic DataFrame-to-DataFrame operators."""
