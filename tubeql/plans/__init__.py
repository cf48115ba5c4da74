"""Configuration, composite plans, and the stage runner."""
