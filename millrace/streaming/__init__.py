"""Statements over tables as streams of rows in arrival order."""
