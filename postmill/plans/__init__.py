"""User-level jobs, and the named queries with the SQL that states the same result."""
