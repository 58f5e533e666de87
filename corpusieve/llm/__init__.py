"""Operators that prepare training corpora. Nothing outside this folder imports it."""
