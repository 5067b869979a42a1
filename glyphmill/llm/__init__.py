"""Operators that prepare recognised text for training. Nothing outside this folder imports them."""
