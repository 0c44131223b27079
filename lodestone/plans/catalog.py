"""Importing this module registers every query of the library."""

from lodestone.plans import core, texts, tools, upkeep  # noqa: F401
