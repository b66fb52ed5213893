"""Named queries over the test tables, each with the SQL that another engine runs for the same rows."""
