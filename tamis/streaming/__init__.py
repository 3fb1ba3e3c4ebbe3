"""Fitted stages on streams."""
