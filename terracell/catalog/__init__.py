"""The catalog: themes, collections, items and assets as flat tables."""
