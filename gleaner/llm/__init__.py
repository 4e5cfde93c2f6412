"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``queries`` holds the thin registered queries that derive the contract's digest columns from them.
"""
