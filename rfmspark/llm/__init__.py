"""Training-data operators: dedup, extraction, privacy, quality, tokenising, packing, neighbour search.

Nothing outside this package imports it; ``queries.py`` holds its registered queries."""
