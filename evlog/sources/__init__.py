"""Where events come from and go to."""
