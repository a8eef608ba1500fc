"""Training-data operators: ten corpus-scale components, one module each.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
