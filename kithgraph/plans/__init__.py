"""Query catalogue and the SQL that states the same results."""
