"""Training-data operators: deduplication, filtering, tokenisation, packing and archives.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
