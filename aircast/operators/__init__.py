"""Relational operators over readings and daily tables."""
