"""A definition document read piece by piece: its parts as they end, whatever the size of the file.

The facts are those of ``definition.read_document``; only open elements and the texts that are
asked for are held.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from xml.parsers import expat

from pyspark import cloudpickle

# executors get these classes themselves, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ASKED = frozenset(("groupId", "id", "name", "class", "comment", "description"))
_PARTS = ("id", "name", "class")


@dataclass
class _Open:
    """An element that has not ended. Its text ends with its first child."""
    tag: str
    texts: list[str] | None = None
    parts: dict = field(default_factory=dict)    # of a processor: its first children by tag
    place: int = 0
    named: "_Open | None" = None                 # of a group: its first name

    def text(self) -> str | None:
        return "".join(self.texts) or None


class Document:
    """Parts of one document: ``processors`` and ``groups`` that have ended, taken by whoever feeds it."""

    def __init__(self):
        self.processors: list[tuple[int, str | None, str | None, str | None]] = []
        self.groups: list[tuple[int, str, str | None]] = []
        self.root = self._stated = self._note = self._root_group = None
        self._stack: list[_Open] = []
        self._open_groups: list[tuple[_Open, str]] = []
        self._n_processors = self._n_groups = 0
        self._reading = False                    # text of the innermost element
        self._parser = expat.ParserCreate("utf-8", "}")
        self._parser.buffer_text = True
        self._parser.StartElementHandler = self._start
        self._parser.EndElementHandler = self._end
        self._parser.CharacterDataHandler = self._data
        self._parser.EntityDeclHandler = self._refuse
        self._parser.SkippedEntityHandler = self._refuse

    def feed(self, data: bytes, last: bool = False) -> None:
        """More of the file; raises ``ValueError`` where it is no document that is accepted."""
        try:
            self._parser.Parse(data, last)
        except expat.ExpatError as problem:
            raise ValueError(str(problem)) from problem

    @property
    def flow_id(self) -> str | None:
        """Text of the first groupId below the root, else the id of the first rootGroup."""
        stated = self._stated.text() if self._stated else None
        return stated.strip() if stated else (self._root_group[0] if self._root_group else None)

    @property
    def description(self) -> str | None:
        return self._note.text() if self._note else None

    def _refuse(self, *_):
        raise ValueError("entity declarations are not accepted")

    def _start(self, tag: str, attributes: dict) -> None:
        above = self._stack[-1] if self._stack else None
        now = _Open(tag, [] if above and tag in _ASKED else None)
        self._stack.append(now)
        self._reading = now.texts is not None
        if above is None:
            self.root = "{" + tag if "}" in tag else tag
            return
        if above.tag == "processor" and len(self._stack) > 2 and tag in _PARTS:
            above.parts.setdefault(tag, now)
        if tag == "processor":
            now.place, self._n_processors = self._n_processors, self._n_processors + 1
        elif tag == "processGroup":
            now.place, self._n_groups = self._n_groups, self._n_groups + 1
            self._open_groups.append((now, attributes.get("id", f"flow_{now.place}")))
        elif tag == "rootGroup":
            self._root_group = self._root_group or (attributes.get("id") or None,)
        elif tag == "groupId":
            self._stated = self._stated or now
        elif tag in ("comment", "description") and len(self._stack) == 2:
            self._note = self._note or now
        elif tag == "name":
            for group, _ in reversed(self._open_groups):
                if group.named is not None:
                    break                        # so have those around it
                group.named = now

    def _end(self, tag: str) -> None:
        now = self._stack.pop()
        self._reading = False
        if tag == "processor" and self._stack and len(now.parts) == len(_PARTS):
            self.processors.append((now.place, *(now.parts[p].text() for p in _PARTS)))
        elif tag == "processGroup" and self._open_groups and self._open_groups[-1][0] is now:
            _, group_id = self._open_groups.pop()
            name = now.named.text() if now.named else f"Flow {now.place + 1}"
            self.groups.append((now.place, group_id, name))

    def _data(self, text: str) -> None:
        if self._reading:
            self._stack[-1].texts.append(text)
