"""A small labelled table for the entity tagger: invented sentences with marked entities.

``[LABEL:...]`` marks an entity; ``{...}`` draws a filler. Everything is made up here.
"""

from __future__ import annotations

import random
import re
import string

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "ID")

_CARRIERS = (
    "the {w} {w} of {w} {E} and {w} in {w}.", "{E} {w} {w} {w}.", "{w} {w} {w}, {w} {w} {E}", "Please {w} to {E}, or {w} {w}.",
    "{W} {w} {w}. {W} {w} {E} {w} {w} {n} {w}.", "la {w} de {w} {E} que {w} le {w}.", "der {w} und die {w} {E} in {w}.", "el {w} {E} {w} por {w} y {w}.",
    "{w} {E}. {W} {w} {w}", "{w} {w} {E}! {W} {w}", "{w}, {E}, {w} {w}.", "contact: {E} {w}", "{W} {w} ({E}) {w} {w}.", "{w} {w} {w} {w} {E} {w} {E}, {w}.",
)
_PLAIN = (
    "{W} {w} {w} {n} {w} {w}.", "{n}. {W} {w} {w} {w}.", "{w} {w} {v} {w} {w} {v}.", "{W}, {w} {w}; {w} {w} - {w} ({w}).", "| {w} | {n} | {w} | {m} |", "{w}### {w}%%% {w}*** {w}$$$ {w}&&&",
    "{W}!! {W}!! {W}.", "In {y} the {w} {w} {m} {w}.", "{w} {d} {w} {w} {t} {w}.", "{W} {w} {W} {w} {W} {w}.", "(c) {y} {W} {W}. All rights reserved.", "http://{w}.{w}.com/{w} {w} {w}", "{w}: {n}% {w} {m} {w}",
    "{U} {U} {U}!! {U}, {U}.", "{w}={n} {w} {w}", "{w} \"{w} {w}\" '{w}' {w}...", "# {W} {w} {n}", "{W} {w} {w} {w} {w} {w} {w}, {w} {w} {w} {w}.", "{w}@ {w} @{w} {w}", "{w} {n} {n} {n} {n}, {n}.", "<{w}> {w} </{w}>", "{w} {x} {w} {x}",
)


def _word(r: random.Random) -> str:
    return "".join(r.choice(("the", "en", "ou", "er", "ing", "tion", "ch", "é", "ci", "ón", "heit", "ß", "la", "re", "st", "ly", "a", "ü", "ñ", "an", "sh")) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _filler(kind: str, r: random.Random) -> str:
    w = _word(r)
    return {
        "w": lambda: w, "W": lambda: w.capitalize(), "U": lambda: (w + _word(r) * r.randint(0, 2)).upper(), "n": lambda: _digits(r, r.randint(1, 5)), "m": lambda: f"{_digits(r, r.randint(1, 3))}.{_digits(r, r.randint(1, 2))}",
        "y": lambda: str(r.randint(1900, 2030)), "d": lambda: r.choice((f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}")), "t": lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}",
        "v": lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", "x": lambda: r.choice((w + _digits(r, 2), w.capitalize() + "-" + w, _digits(r, 1) + w, w + "." + w, w + "/" + w, w + "_" + w)),
    }[kind]()


def _entity(r: random.Random) -> tuple[str, str]:
    low = lambda a, b: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(a, b)))
    label = r.choice(LABELS[1:])
    if label == "EMAIL":
        user = r.choice((low(3, 9), f"{low(3, 8)}.{low(3, 8)}", f"{low(2, 8)}.{_digits(r, 2)}", f"{low(3, 7)}_{_digits(r, 2)}", f"{low(2, 6)}{_digits(r, 3)}", f"{low(2, 5)}+{low(2, 5)}"))
        host = r.choice((f"{low(1, 9)}", f"{low(3, 6)}{r.randint(1, 9)}.{low(4, 8)}", f"{low(3, 6)}-{low(3, 6)}"))
        return label, f"{user}@{host}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'co.uk', 'io'))}"
    if label == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return label, r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(20, 99)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"))
    if label == "CARD":
        g = [str(r.choice((4, 5, 3))) + _digits(r, 3), *(_digits(r, 4) for _ in range(3))]
        return label, r.choice(("".join(g), "".join(g), "".join(g), "-".join(g), " ".join(g)))
    if label == "IP":
        if r.random() < 0.2:
            return label, ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)) if r.random() < 0.5 else f"2001:db8:{r.randint(0, 65535):x}::{r.randint(1, 65535):x}"
        return label, ".".join(str(r.randint(1, 255)) for _ in range(4))
    if label == "SECRET":
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 24, 32, 40, 64))))
        letters = string.ascii_uppercase + (string.digits if r.random() < 0.7 else "")
        upper = "".join(r.choice(letters) for _ in range(16))
        mixed = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(24, 40)))
        return label, r.choice((f"password={hexes[:18]}", f"AKIA{upper}", f"AKIA{upper}", f'"{hexes}"', hexes, f"api_key={mixed}", f"ghp_{mixed}", f"token={hexes}", f"secret={mixed}", f"passwd={low(6, 12)}{_digits(r, 3)}"))
    return label, r.choice((f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"DE{_digits(r, 20)}", f"FR{_digits(r, 25)}"))


def labelled_table(rows: int = 1200, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Sentences as tokens and their labels; a third have no entity."""
    r, out = random.Random(seed), []
    for k in range(rows):
        line = r.choice(_PLAIN) if k % 3 == 0 else r.choice(_CARRIERS)
        tokens: list[str] = []
        labels: list[str] = []
        for piece in line.split(" "):
            if "{E}" in piece:
                before, after = piece.split("{E}")
                label, value = _entity(r)
                own = value.split(" ")
                own[0], own[-1] = before + own[0], own[-1] + after
                tokens += own
                labels += [label] * len(own)
            else:
                tokens.append(re.sub(r"\{(\w)\}", lambda m: _filler(m[1], r), piece))
                labels.append("O")
        out.append((tokens, labels))
    return out
