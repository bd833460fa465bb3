"""Plans of winaudit."""
