"""Training-data operators (tokens, chat, duplicates, packing, archives, scans, quality).

Each operator module holds a general DataFrame function built by its own method; ``queries`` holds
the thin registered queries and their SQL. Nothing else in ``innsight`` imports this package.
"""
