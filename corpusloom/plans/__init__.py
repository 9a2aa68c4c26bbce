"""Plans of the analytics library."""
