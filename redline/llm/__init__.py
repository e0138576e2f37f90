"""Training-data operators: ten corpus operators, each in a module of its own.

Nothing outside this subpackage imports it; ``queries.py`` binds the operators
to the driver's tables.
"""
