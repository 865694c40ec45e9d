"""Content inventory jobs for Spark: indexing, matching, auditing and reporting."""
