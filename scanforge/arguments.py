"""Arguments of programs: declared tags with a number of values, and files that are told apart by their extensions."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class Tag:
    """A tag such as -r with its number of values, or, with extensions, a file that needs no tag."""

    name: str
    help: str = ""
    values: int = 0
    required: bool = False
    extensions: tuple[str, ...] = ()


def parse(tags: list[Tag], words: list[str]) -> dict[str, list[str] | bool]:
    """Values by tag name: a list for tags with values or extensions, else whether the tag is there.

    Words that belong to no tag are matched by extension, whatever its case; ValueError if one matches none, if a required tag is
    missing, or if a tag has too few values.
    """
    parser = argparse.ArgumentParser(add_help=False, exit_on_error=False, allow_abbrev=False)
    for t in tags:
        if not t.extensions:
            parser.add_argument(t.name, dest=t.name, help=t.help, **({"nargs": t.values, "action": "extend", "default": []} if t.values else {"action": "store_true"}))
    try:
        known, rest = parser.parse_known_args(words)
    except (argparse.ArgumentError, SystemExit) as e:
        raise ValueError(str(e)) from e
    out: dict[str, list[str] | bool] = {t.name: getattr(known, t.name) for t in tags if not t.extensions} | {t.name: [] for t in tags if t.extensions}
    for word in rest:
        fits = [t for t in tags if t.extensions and word.lower().endswith(tuple(e.lower() for e in t.extensions))]
        if not fits:
            raise ValueError(f"unknown argument {word}")
        out[fits[0].name].append(word)
    missing = [t.name for t in tags if t.required and not out[t.name]]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")
    return out
