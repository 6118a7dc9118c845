"""The operators run on the given tables, each query beside the SQL that must give the same rows."""
