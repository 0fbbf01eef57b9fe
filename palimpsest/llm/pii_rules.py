"""Personal data by pattern: leftmost non-overlapping matches per kind, each in time linear in the text."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2][:]) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the characters of a local part before it (none of an earlier match) and a dotted domain behind it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        # Characters up to this @ belong to no later local part, as @ is in none.
        end = domain.end() if domain else at + 1
        at = text.find("@", max(end, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four numbers with dots between, out of each longest dotted run, from its left."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            # int() refuses more than 4300 digits, zeros before the number included.
            if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def is_card(found: str) -> bool:
    digits = _NO_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _DIGITS.finditer(text) if is_card(m.group())]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; every kind has a digit or an @."""
    return [(k, *s) for k, find in enumerate((emails, ips, cards, phones)) for s in find(text)]
