"""Every operator run over the given tables, with the same result stated in SQL where SQL can."""
