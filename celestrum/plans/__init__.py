"""Named query plans with their SQL oracles."""
