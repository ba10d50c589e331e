"""Functions over columns: keys, selectors, resources, scalars."""
