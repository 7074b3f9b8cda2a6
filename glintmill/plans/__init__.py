"""Named queries by subject, each with the SQL that checks it."""
