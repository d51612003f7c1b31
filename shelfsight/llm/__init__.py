"""Operators of a training-data pipeline over text, page and chat tables.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` registers the thin queries over the generated tables
and ``oracle`` their SQL.
"""
