"""Training-data operators: filters, formats, scores, tokens, joins and web archives.

Nothing else in the library imports this subpackage.
"""
