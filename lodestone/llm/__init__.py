"""Training-data operators: ten corpus operations built for very large inputs.

Nothing else in the library imports this subpackage.
"""
