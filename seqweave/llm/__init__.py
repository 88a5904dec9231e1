"""Operators for preparing training data from event sequences and documents."""
