"""Operators for preparing training text; nothing else in bitloom imports this subpackage."""
