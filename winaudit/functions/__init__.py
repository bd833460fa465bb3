"""Column helpers and the distributed primitives that the operators share."""
