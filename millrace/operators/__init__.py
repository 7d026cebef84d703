"""Operators that are more than one built-in call: row-count windows, runs, row processing."""
