"""Where cubes come from and go to."""
