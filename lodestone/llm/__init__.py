"""Training-data operators: each module holds one operator with its own general interface.

``registry`` registers the contract queries; nothing outside this subpackage imports it but
the guarded hook in ``__spark_entry__``.
"""
