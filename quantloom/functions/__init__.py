"""Subpackage of quantloom."""
