"""Part of bitloom."""
