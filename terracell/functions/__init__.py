"""Functions on columns that are no operators of their own."""
