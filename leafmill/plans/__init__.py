"""Recipes: step lists over file tables."""
