"""Operators for preparing training corpora: one module an operator.

Nothing outside this subpackage imports it; `registry` holds its queries and SQL.
"""
