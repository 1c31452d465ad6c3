"""Plans that join several operators."""
