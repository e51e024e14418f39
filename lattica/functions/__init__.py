"""Column functions of identities and names."""
