"""End-to-end plans over the given tables: stages, registered queries and their SQL."""
