"""Scalar expressions shared by the operators; all are built-in Column expressions."""
