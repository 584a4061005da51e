"""Networks made from tables, and the registered queries with their SQL."""
