"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  ``entries.queries()`` and
``entries.oracle_sql()`` are what the driver contract adds when the
subpackage is present.
"""
