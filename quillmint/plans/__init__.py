"""Domain reports composed from the operators."""
