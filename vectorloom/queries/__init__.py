"""Registered queries, by area; importing the modules fills the registry."""
