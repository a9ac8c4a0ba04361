"""The text functions of a query on the driver: a handful of short strings."""

from __future__ import annotations

import regex

from .text import FOLDED, FOLDS_TO

_FOLD = str.maketrans(FOLDED[: len(FOLDS_TO)], FOLDS_TO, FOLDED[len(FOLDS_TO) :])


def normalize(text: str | None) -> str:
    return regex.sub(r"[^\p{L}\p{N}_]+", " ", (text or "").strip().lower()).strip()


def fold_tokens(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}\p{Co}]+", text.lower().translate(_FOLD))


def path_words(path: str) -> list[str]:
    base = path.rsplit("/", 1)[-1]
    return normalize(base.rsplit(".", 1)[0] if "." in base else base).split()


def first_path_word(path: str) -> str:
    return next(iter(path_words(path)), "")


def first_word(text: str) -> str:
    return next(iter(normalize(text).split()), "")
