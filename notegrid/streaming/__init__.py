"""Streams."""

from notegrid.streaming.ordered import ordered_selections, replayed
from notegrid.streaming.selection import selections

__all__ = ["ordered_selections", "replayed", "selections"]
