"""The stack of open elements, with an index: who is open, and what bounds a search for it.

Searches of the stack end at the nearest element of some set (a scope). Deep input
makes such walks quadratic, so the places of each name and of each such set are kept
beside the stack; a search is then a comparison of two last places. Elements come
and go at the top; a change further down renews the index above it.
"""

from __future__ import annotations

from collections.abc import Iterable

from .chars import HTML, ascii_lower
from .names import BUTTON_SCOPE, LIST_SCOPE, SCOPE, SPECIAL, TABLE_SCOPE
from .tree import Node

#: What ends the search for an open list item.
ITEM_BOUND = SPECIAL - {(HTML, name) for name in ("address", "div", "p")}
#: What an insertion mode can be told from.
MODAL = frozenset((HTML, name) for name in "td th tr tbody thead tfoot caption colgroup table template head body frameset html".split())
BOUNDS = (SCOPE, LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE, SPECIAL, ITEM_BOUND, MODAL)
#: The sets that hold a key, for all keys that are in one.
_WITHIN = {key: tuple(bound for bound in BOUNDS if key in bound) for key in frozenset().union(*BOUNDS)}


class OpenElements(list):
    """A list of nodes; ``node.at`` is a node's place in it, -1 for others."""

    def __init__(self):
        super().__init__()
        self._lower: dict[str, list[int]] = {}  # places of elements that are not HTML, by lower-cased name
        self._bounds: dict[frozenset, list[int]] = {bound: [] for bound in BOUNDS}
        self._kept: dict[tuple[str, str], tuple[list[int], ...]] = {}
        self._html: dict[str, list[int]] = {}
        self.foreign = 0  # open elements that are not HTML

    def _lists(self, key: tuple[str, str]) -> tuple[list[int], ...]:
        own = [[], *(self._bounds[bound] for bound in _WITHIN.get(key, ()))]
        if key[0] == HTML:
            self._html[key[1]] = own[0]
        else:
            own.append(self._lower.setdefault(ascii_lower(key[1]), []))
        self._kept[key] = tuple(own)
        return self._kept[key]

    def append(self, node: Node) -> None:
        key, place = (node.ns, node.name), len(self)
        for places in self._kept.get(key) or self._lists(key):
            places.append(place)
        if key[0] != HTML:
            self.foreign += 1
            if place:
                below = self[-1]
                node.html_below = place - 1 if below.ns == HTML else below.html_below
        node.at = place
        super().append(node)

    def pop(self) -> Node:
        node = super().pop()
        for places in self._kept[node.ns, node.name]:
            places.pop()
        if node.ns != HTML:
            self.foreign -= 1
        node.at = -1
        return node

    def _renew(self, place: int, nodes: Iterable[Node]) -> None:
        """What lies above a place becomes these nodes."""
        while len(self) > place:
            self.pop()
        for node in nodes:
            self.append(node)

    def cut(self, place: int) -> None:
        self._renew(place, ())

    def __delitem__(self, place: int) -> None:
        self._renew(place, self[place + 1 :])

    def __setitem__(self, place: int, node: Node) -> None:
        self._renew(place, [node, *self[place + 1 :]])

    def insert(self, place: int, node: Node) -> None:
        self._renew(place, [node, *self[place:]])

    def remove(self, node: Node) -> None:
        del self[node.at]

    def last(self, *names: str) -> int:
        """The highest place of an HTML element of these names; -1 if none is open."""
        highest = -1
        for name in names:
            places = self._html.get(name)
            if places and places[-1] > highest:
                highest = places[-1]
        return highest

    def last_of(self, bound: frozenset) -> int:
        places = self._bounds[bound]
        return places[-1] if places else -1

    def last_foreign(self, name: str) -> int:
        """The highest place of an element that is not HTML, by its lower-cased name."""
        places = self._lower.get(name)
        return places[-1] if places else -1

    def first_after(self, bound: frozenset, place: int) -> int | None:
        """The lowest place above a place with an element of the set."""
        places = self._bounds[bound]
        low, high = 0, len(places)
        while low < high:
            middle = (low + high) // 2
            if places[middle] > place:
                high = middle
            else:
                low = middle + 1
        return places[low] if low < len(places) else None
