"""Physical building blocks that Catalyst has no operator for."""
