"""A bounded memo for what workers look up again and again."""

from __future__ import annotations


class Memo:
    """Two generations: when the young one is full, the old one goes.

    What is asked for often stays; at most ``2 * limit`` entries are held.
    """

    __slots__ = ("limit", "old", "young")

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key: object) -> object | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: object, value: object) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value
