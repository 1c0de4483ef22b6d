"""Tools that make texts with a model: what one is, what it must keep to, and its output without banned phrases."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from .contract import strings
from .studio import MOST_INPUT_WORDS, RUNS_AN_HOUR


class ToolError(ValueError):
    """A run that isn't allowed, or a tool or run that there is not."""


class Tool(NamedTuple):
    """``run`` (inputs, profile) gives the output and its tokens (prompt_tokens, completion_tokens, model); ``regenerate`` (inputs, block, profile) one block of it; ``words`` counts the inputs' words."""

    run: Callable[[dict, str], tuple[dict, dict]]
    words: Callable[[dict], int]
    regenerate: Callable[[dict, str, str], tuple[object, dict]] | None = None

    def block(self, inputs: dict, name: str, profile: str) -> tuple[object, dict]:
        """One block anew: by the tool's own way, or from a whole run."""
        if self.regenerate:
            return self.regenerate(inputs, name, profile)
        output, spent = self.run(inputs, profile)
        return output.get(name), spent


def allowed(words: int, in_hour: int) -> None:
    if words > MOST_INPUT_WORDS:
        raise ToolError(f"the input has {words} words, more than {MOST_INPUT_WORDS}")
    if in_hour >= RUNS_AN_HOUR:
        raise ToolError(f"{in_hour} runs in the last hour")


def without(output: object, banned: list[str]) -> tuple[object, list[str]]:
    """The nested output without the banned phrases, whole ones in any case, and those that were found, sorted."""
    found: set[str] = set()

    def clean(text: str) -> str:
        for phrase in banned:
            new, n = re.subn(rf"(?<!\w){re.escape(phrase)}(?!\w)", "", text, flags=re.IGNORECASE)
            if n:
                found.add(phrase)
                text = re.sub(r" {2,}", " ", new).strip()
        return text

    return strings(output, clean), sorted(found)
