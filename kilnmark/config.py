"""Settings from indented text: a small subset of YAML, read on the driver.

Mappings by indentation, '- ' list items, inline {..} and [..], quoted strings, comments; null is None.
"""

from __future__ import annotations

import hashlib
import re

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
# Words for truth, falsehood and nothing.
_WORDS = {"true": True, "false": False, "yes": True, "no": False, "null": None, "~": None, "": None}
BARS_PER_DAY_UNITS = {"m": 1440, "h": 24, "d": 1}


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _split(text: str) -> list[str]:
    """Parts between commas that lie outside of quotes and brackets."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p for p in [*parts, text[start:]] if p.strip()]


def _key(text: str) -> tuple[str, str] | None:
    """Key and rest of 'key: rest', if it is that."""
    m = re.match(r"""\s*("[^"]*"|'[^']*'|[^\s:"'\[\]{},][^:\[\]{},]*?)\s*:(?:\s+|$)""", text)
    return (m[1].strip("\"'"), text[m.end() :]) if m else None


def value(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [value(p) for p in _split(text[1:-1])]
    if text[:1] == "{" and text[-1:] == "}":
        pairs = [_key(p) for p in _split(text[1:-1])]
        if None in pairs:
            raise ValueError(f"not a mapping: {text}")
        return {k: value(v) for k, v in pairs}
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if _NUMBER.fullmatch(text):
        return float(text) if re.search(r"[.eE]", text) else int(text)
    return text


def parse(text: str) -> dict:
    lines = [(len(u) - len(u.lstrip()), u.strip()) for u in map(_uncommented, text.splitlines()) if u.strip()]

    def block(at: int, indent: int):
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] >= indent:
            depth, line = lines[at]
            if depth > indent:
                raise ValueError(f"unexpected indent before {line!r}")
            at += 1
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                item = line[2:].strip()
                out.append(value(item))
                continue
            found = _key(line)
            if found is None:
                raise ValueError(f"no key in {line!r}")
            out = {} if out is None else out
            key, rest = found
            if rest.strip():
                out[key] = value(rest)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def flat(config: dict, prefix: str = "") -> dict[str, object]:
    """Dotted keys of all leaves."""
    out = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out


def config_hash(config: dict) -> str:
    """SHA-256 of the sorted leaves: equal settings, equal hash."""
    return hashlib.sha256("\n".join(f"{k}={v!r}" for k, v in sorted(flat(config).items())).encode()).hexdigest()


def bars_per_day(interval: str) -> int:
    """Bars of an interval such as 5m, 1h or 1d in a day; anything else is an error."""
    m = re.fullmatch(r"(\d+)([mhd])", interval)
    if not m or not int(m[1]):
        raise ValueError(f"no interval: {interval}")
    return max(1, BARS_PER_DAY_UNITS[m[2]] // int(m[1]))
