"""Operators that a training-data pipeline needs beside the evidence engine.

Nothing outside this subpackage imports it.
"""
