"""Message texts by bundle and key, with printf places."""

from __future__ import annotations

import re
from functools import lru_cache


def parse_bundle(text: str) -> dict[str, str]:
    """Markdown: `# key` starts a message; the lines up to the next are its text."""
    parts = re.split(r"(?m)^# +(\S+)[ \t]*$", text)
    return {k: v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}


@lru_cache(maxsize=None)
def bundle(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        return parse_bundle(f.read())


def message(path: str, key: str, *values) -> str:
    try:
        return bundle(path)[key] % values
    except KeyError:
        raise KeyError(f"no message {key!r} in {path}") from None


def messages(path: str, key: str) -> list[str]:
    """A message of several items: its lines, list marks removed."""
    return [re.sub(r"^[*-] +", "", line) for line in message(path, key).splitlines() if line.strip()]
