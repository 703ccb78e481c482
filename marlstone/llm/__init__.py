"""Training-data operators.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``registry`` turns them into the ``opN_*``
queries and holds their SQL.
"""
