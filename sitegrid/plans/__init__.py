"""Views over the driver's tables, the operators' queries on them, and the SQL that must give the same rows."""
