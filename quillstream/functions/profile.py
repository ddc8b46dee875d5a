"""What dialogue, attribution and chapter operators know of a language, as tables of plain values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillstream.functions import values


@dataclass(frozen=True)
class Profile:
    """A language.  quotes: opening and closing mark, and whether the pair counts only where single quotes do, in the order of
    precedence; speech: a verb and the emotion that it tells, if any."""

    quotes: tuple[tuple[str, str, bool], ...] = ()
    speech: tuple[tuple[str, str | None], ...] = ()
    not_names: tuple[str, ...] = ()
    name_pattern: str = values.NAME_PATTERN
    headings: tuple[str, ...] = ()
    breaks: tuple[str, ...] = ()


ENGLISH = Profile(
    quotes=(*((a, b, False) for a, b in (*values.DOUBLE_QUOTES, *values.CURLY_QUOTES)), *((a, b, True) for a, b in values.SINGLE_QUOTES)),
    speech=tuple((v, values.EMOTION_HINTS.get(v)) for v in values.SPEAKER_VERBS), not_names=values.SPEAKER_BLACKLIST,
    headings=values.CHAPTER_PATTERNS, breaks=values.SCENE_BREAK_PATTERNS,
)
#: Profiles by language code; a program adds its own here.
PROFILES: dict[str, Profile] = {"en": ENGLISH}


def language(code: str) -> Profile:
    """The profile of a code; ValueError for a language without one."""
    found = PROFILES.get(code)
    if found is None:
        raise ValueError(f"{code!r} is none of the languages {list(PROFILES)}")
    return found


def mood_verbs(profile: Profile) -> dict[str, str]:
    """Verb and emotion of the verbs that tell one, by name."""
    return {v: mood for v, mood in sorted(profile.speech) if mood}


def said_patterns(profile: Profile) -> list[str]:
    """The fixed patterns of who speaks, with the language's verbs put in; the name is group 1."""
    verbs = "|".join(re.escape(v) for v, _ in sorted(profile.speech))
    return [p.replace("VERBS", verbs) for p in values.SAID_PATTERNS] if verbs else []
