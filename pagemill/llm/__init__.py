"""Operators that prepare text for training; nothing else in pagemill imports this subpackage."""
