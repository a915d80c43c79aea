"""Readers of scenario files, prompt files, trajectories and of the test tables."""
