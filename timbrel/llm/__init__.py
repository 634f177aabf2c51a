"""Training-data operators: one module per operator, each DataFrame in, DataFrame out.

Nothing outside this package imports it.  ``entry.py`` holds the registered queries.
"""
