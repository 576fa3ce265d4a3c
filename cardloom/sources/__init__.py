"""Input tables and their views."""
