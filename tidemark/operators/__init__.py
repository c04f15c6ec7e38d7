"""Series operators as DataFrame transformations."""
