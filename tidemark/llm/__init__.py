"""Operators for preparing training text: tokenizing, archiving, deduplicating, scoring, packing.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
