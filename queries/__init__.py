"""Registered queries: every operator of the library on the test tables, with its oracle SQL."""
