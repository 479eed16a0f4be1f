"""Operators over texts, vectors and files of training-data collections."""
