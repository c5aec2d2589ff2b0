"""Training-data operators: one module an operator, queries in ``registry``.

Nothing else in the library imports this subpackage.
"""
