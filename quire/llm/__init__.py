"""Operators for training-data corpora; nothing else in the library imports this subpackage.

Each operator names its method and its defined results. For all of them: a null
key is a row like any other, with null where the result is an id compared with it
(kept, component); the key and text columns are parameters, and no other column
is looked at.
"""
