"""Operators for preparing language-model training text, one module per operator.

Nothing outside this package imports it.  ``registry`` lists the queries and their SQL.
"""
