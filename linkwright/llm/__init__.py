"""Training-data operators: ten self-contained corpus operators and their queries.

Nothing outside this subpackage imports it.
"""
