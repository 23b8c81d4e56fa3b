"""Operators that prepare text for training; each module is one operator."""
