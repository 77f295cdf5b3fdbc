"""Whole rewrites: profiles, guards and the order of passes."""
