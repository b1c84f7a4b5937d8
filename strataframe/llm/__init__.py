"""Training-data operators: near-duplicate and substring removal, scoring, scans and tokenisation.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
