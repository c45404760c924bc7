"""Scalar expressions and rule tables."""
