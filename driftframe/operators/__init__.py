"""The comparison as DataFrame operations: projection, matching, statuses, counts and examples."""
