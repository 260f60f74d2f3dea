"""Registered end-to-end queries over the test tables and their SQL oracles."""
