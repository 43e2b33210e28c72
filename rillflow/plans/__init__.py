"""Registered queries: each is a plan over the tables and, where SQL can say it, the same in SQL."""
