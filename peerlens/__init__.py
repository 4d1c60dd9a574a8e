"""Group-relative analytics on Spark: describe, match and rank rows relative to their peers."""
