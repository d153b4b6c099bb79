"""The named queries, each with SQL that must give the same rows."""
