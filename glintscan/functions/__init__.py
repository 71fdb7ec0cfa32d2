"""Column functions: usable on their own in any DataFrame expression."""
