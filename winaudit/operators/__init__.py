"""Operators of winaudit."""
