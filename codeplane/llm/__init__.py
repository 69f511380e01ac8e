"""Operators that prepare training data from code and documents.

Nothing outside this package imports it; its queries join the entry point only if it is there.
"""
