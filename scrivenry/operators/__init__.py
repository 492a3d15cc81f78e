"""Relational operators over passages, events and states."""
