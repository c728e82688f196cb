"""Operators for preparing training text at corpus scale.

One module per operator, plus ``queries`` (the registered queries and their
SQL). Nothing outside this package imports it.
"""
