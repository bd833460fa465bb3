"""Sources of winaudit."""
