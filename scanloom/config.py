"""Settings of a scan: limits, switches, and what is wrong with them."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, replace

# Names of languages that a scan may be asked for, and the language each means.
LANGUAGES = {"js": "javascript", "ts": "typescript", "python": "python", "java": "java", "c": "c", "cpp": "cpp"}
#: Parts of the plan that an ablation run may switch off.
PARTS = ("retrieval", "frameworks", "functions", "judge", "verify")
log = logging.getLogger("scanloom")


@dataclass(frozen=True)
class Settings:
    """A scan's settings; ``problems`` says what is wrong with them."""

    languages: tuple[str, ...] = tuple(LANGUAGES)
    out: str = "reports"
    root: str | None = None
    threshold: float = 0.5
    max_tokens: int = 600
    budget: float = 10.0
    switch_at: float = 8.0
    within: int = 3
    max_distance: int = 40
    off: frozenset[str] = field(default_factory=frozenset)

    def problems(self) -> list[str]:
        """What is wrong, in the order of the settings; [] for valid ones."""
        said = []
        if self.root is not None and not os.path.isdir(self.root):
            said.append(f"root is no directory: {self.root}")
        if not self.out:
            said.append("out is empty")
        if not self.languages:
            said.append("no language")
        said += [f"unknown language: {x}" for x in self.languages if x not in LANGUAGES]
        if not 0 <= self.threshold <= 1:
            said.append("threshold must lie in 0 to 1")
        if self.max_tokens < 1:
            said.append("max_tokens must be positive")
        if self.budget <= 0:
            said.append("budget must be positive")
        if self.within < 0 or self.max_distance < 0:
            said.append("distances must not be negative")
        said += [f"unknown part: {x}" for x in sorted(self.off - set(PARTS))]
        return said

    def checked(self) -> Settings:
        """Itself; raises ValueError for invalid settings."""
        if said := self.problems():
            raise ValueError("; ".join(said))
        return self

    def uses(self, part: str) -> bool:
        """Whether a part of the plan is on."""
        return part not in self.off

    def names(self) -> tuple[str, ...]:
        """The languages as ``functions.paths`` calls them."""
        return tuple(LANGUAGES[x] for x in self.languages if x in LANGUAGES)


def wanted_languages(text: str) -> tuple[str, ...]:
    """Known languages of a comma-separated list; unknown ones are logged and dropped, none left is an error."""
    names = [x.strip().lower() for x in text.split(",") if x.strip()]
    for x in names:
        if x not in LANGUAGES:
            log.warning("unknown language is left out: %s", x)
    known = tuple(dict.fromkeys(x for x in names if x in LANGUAGES))
    if not known:
        raise ValueError(f"no known language, choose among {', '.join(LANGUAGES)}")
    return known


def ablated(settings: Settings, text: str) -> Settings:
    """Settings without the parts of a comma-separated list."""
    return replace(settings, off=settings.off | {x.strip() for x in text.split(",") if x.strip()})
