"""Relational and trace operators."""
