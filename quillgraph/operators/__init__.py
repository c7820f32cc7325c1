"""Graph and table operators as DataFrame transformations."""
