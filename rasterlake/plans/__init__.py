"""Conversion planning as batch decision tables."""
