"""Operators of a training-data pipeline over documents, pages and conversations.

One module per operator; ``queries`` holds the registered queries and their SQL.
Nothing else in the library imports this package.
"""
