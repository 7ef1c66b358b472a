"""The driver tables seen as shop tables, with the registered queries and their SQL."""
