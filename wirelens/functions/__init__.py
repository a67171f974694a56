"""Column functions over text, addresses and byte strings."""
