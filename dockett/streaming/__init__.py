"""Runs over mails as they come in."""
