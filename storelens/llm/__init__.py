"""Training-data operators: each module holds one operator; ``catalog`` registers their queries.

Nothing else in the library imports this subpackage.
"""
