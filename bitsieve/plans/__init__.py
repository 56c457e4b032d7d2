"""Logical plans shared by the operators."""
