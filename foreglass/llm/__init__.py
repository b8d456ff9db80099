"""Operations for preparing training text at scale.

Each module holds one operator with its own general interface. ``queries`` applies
them to the given tables, ``oracles`` has SQL for those that SQL can state. Nothing
else in the library imports this subpackage.
"""
