"""Reading and writing of tables, listings, lists and media."""
