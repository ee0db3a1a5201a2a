"""Expression helpers shared by all operators."""
