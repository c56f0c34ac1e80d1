"""Memories of words that tasks keep while they run, bounded by bytes."""

from __future__ import annotations

from collections.abc import Sized

#: Bytes of a dictionary's place and of the heads of the two objects in it.
PLACE = 130


class Remembered(dict):
    """Words and what they were turned into, emptied once they hold ``most`` bytes.

    It changes speed only: what was forgotten is worked out again.
    """

    def __init__(self, most: int = 16 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def add(self, word: Sized, value: object, extra: int = 0) -> None:
        self[word] = value
        self.held += len(word) + extra + PLACE

    def make_room(self) -> None:
        """Called between texts: forgets everything if too much is held."""
        if self.held > self.most:
            self.clear()
            self.held = 0
