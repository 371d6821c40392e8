"""Training-data operators: each module holds one operator, queries.py binds them to the tables."""
