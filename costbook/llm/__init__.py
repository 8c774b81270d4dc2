"""Operators for building training corpora; nothing outside this package and its tests imports it."""
