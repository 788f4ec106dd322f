"""Where files come from and where results go."""
