"""Span, transcript and measurement analytics as DataFrame operators."""
