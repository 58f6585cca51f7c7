"""Scalar functions over columns and over syntax trees."""
