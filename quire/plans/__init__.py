"""Query catalogue: the named queries and the SQL they are checked against."""
