"""Names of data, models and checkpoints, resolved from a catalogue of sections."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from pathlib import PurePosixPath
from typing import TypeVar, get_type_hints

T = TypeVar("T")


@dataclass(frozen=True)
class Catalog:
    """``sections``: section -> key -> path or (for checkpoints) run -> step -> path; ``bases``: section -> folder that relative paths hang under.

    ``rules``: section -> rules in order, of which the first that holds gives the folder instead: a set of keys,
    a pattern that the path must match from its start, or a pattern to be found anywhere (ending in ``...``), and
    the names of folders in ``folders``, the first that is known."""

    sections: dict[str, dict] = field(default_factory=dict)
    bases: dict[str, str] = field(default_factory=dict)
    rules: dict[str, tuple[tuple[frozenset[str] | str, tuple[str, ...]], ...]] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)

    def base(self, section: str, key: str, path: str) -> str | None:
        """The folder that a relative path of a section hangs under."""
        for when, names in self.rules.get(section, ()):
            holds = key in when if isinstance(when, frozenset) else when[:-3] in path if when.endswith("...") else path.startswith(when)
            if holds and (known := [n for n in names if n in self.folders]):
                return self.folders[known[0]]
        return self.bases.get(section)

    def resolve(self, tag: str) -> str:
        """``section:key`` (or ``section:run:step``) as a path; a tag without a colon is a path already. Unknown names raise KeyError."""
        tag = tag.strip()
        section, colon, key = tag.partition(":")
        if not colon:
            return tag
        section, key = section.strip(), key.strip()
        if section not in self.sections:
            raise KeyError(f"no section {section!r}; there are {sorted(self.sections)}")
        run, colon, step = key.partition(":")
        entry = self.sections[section]
        if run not in entry:
            raise KeyError(f"no {run!r} in {section!r}")
        found = entry[run]
        if isinstance(found, dict):
            step = step or default_step(found)
            if step not in found:
                raise KeyError(f"no step {step!r} of {run!r}")
            found = found[step]
        path = PurePosixPath(found)
        base = None if path.is_absolute() else self.base(section, run, found)
        return str(path if base is None else PurePosixPath(base) / path)


def default_step(steps: dict[str, str]) -> str:
    """``final`` if there is one, else the last in text order ("500" comes after "1000")."""
    if not steps:
        raise KeyError("no steps")
    return "final" if "final" in steps else max(steps)


def settings(kind: type[T], values: dict | None, aliases: dict[str, str] | None = None, defaults: dict | None = None) -> T:
    """A dataclass from a nested dict: old names (``aliases``: old -> new) give way to new ones that are there, ``defaults`` fill what is null, unknown names raise TypeError.

    Fields that are dataclasses themselves are made from their own dicts; null or nothing gives their defaults."""
    given = dict(values or {})
    for old, new in (aliases or {}).items():
        if old in given:
            found = given.pop(old)
            given.setdefault(new, found)
    for name, value in (defaults or {}).items():
        if given.get(name) is None:
            given[name] = value
    hints = get_type_hints(kind)
    for f in fields(kind):
        if is_dataclass(hints[f.name]) and not is_dataclass(given.get(f.name)) and (f.name in given or f.default_factory is not MISSING):
            given[f.name] = settings(hints[f.name], given.get(f.name))
    return kind(**given)
