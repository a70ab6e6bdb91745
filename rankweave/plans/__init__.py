"""Named plans over the test tables, and the SQL that says the same."""
