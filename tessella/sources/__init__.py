"""Readers of delimited observations and stores of model parameters."""
