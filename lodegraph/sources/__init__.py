"""Where graphs come from and are kept."""
