r"""Regular expressions written once, compiled for Java here and for RE2 in the checks.

The rule literals use ECMAScript meaning: ``\b`` and ``\w`` are ASCII, ``i`` folds case. Java 17 treats ``\b``
as Unicode-aware, so it is spelled out as an ASCII boundary. A leading or trailing ``\b`` that provably touches
a word character needs only a one-sided look-around, which is several times cheaper to match. Rules of several
alternatives look at the next character first, so that most places of a text are passed with one test. A rule that is
only tested, not cut out, has the common beginnings of its alternatives written once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BEFORE_WORD = r"(?<![A-Za-z0-9_])"
_AFTER_WORD = r"(?![A-Za-z0-9_])"
_WORD_CLASS = re.compile(r"\[[A-Za-z0-9_-]+\]")


def _close(pattern: str, start: int) -> int:
    """Index of the parenthesis that closes the one at ``start``."""
    depth, i, in_class = 0, start, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def _alternatives(body: str) -> list[str]:
    """Top-level alternatives of a group body."""
    parts, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(body[start:i])
            start = i + 1
        i += 1
    return [*parts, body[start:]]


def _atoms(alternative: str) -> list[tuple[str, bool]]:
    """The atoms of an alternative in order, each with whether it may be absent."""
    atoms, i = [], 0
    while i < len(alternative):
        start, ch = i, alternative[i]
        if ch == "\\":
            i += 2
        elif ch == "(":
            i = _close(alternative, i) + 1
        elif ch == "[":
            i = alternative.index("]", i + 1) + 1
        else:
            i += 1
        atom = alternative[start:i]
        quantifier = re.match(r"(?:[?*+]|\{\d+(?:,\d*)?\})\??", alternative[i:])
        optional = bool(quantifier) and (quantifier.group()[0] in "?*" or quantifier.group().startswith("{0"))
        i += quantifier.end() if quantifier else 0
        atoms.append((atom, optional))
    return atoms


def _is_word_atom(atom: str, at_end: bool) -> bool:
    if atom in (r"\d", r"\w") or (len(atom) == 1 and re.fullmatch(r"[A-Za-z0-9_]", atom)):
        return True
    if _WORD_CLASS.fullmatch(atom):
        return "-" not in atom or bool(re.fullmatch(r"\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\]", atom))
    if atom.startswith("(") and not atom.startswith(("(?=", "(?!", "(?<")):
        body = atom[3:-1] if atom.startswith("(?:") else atom[1:-1]
        return all(_touches_word(part, at_end) for part in _alternatives(body))
    return False


def _touches_word(alternative: str, at_end: bool) -> bool:
    """The text matched by the alternative certainly starts (or ends) with a word character."""
    for atom, optional in reversed(_atoms(alternative)) if at_end else _atoms(alternative):
        if not _is_word_atom(atom, at_end):
            return False
        if not optional:
            return True
    return False


def _edges(alternative: str) -> str:
    """Rewrite the boundaries of one alternative, recursively inside its groups."""
    out, rest = "", alternative
    while rest:
        at = re.match(r"\\b", rest)
        if at:
            after = rest[2:]
            if after and _touches_word(after, False):
                out += _BEFORE_WORD
            elif out and _touches_word(alternative[: len(alternative) - len(rest)], True):
                out += _AFTER_WORD
            else:
                out += _EDGE
            rest = after
        elif rest[0] == "\\":
            out, rest = out + rest[:2], rest[2:]
        elif rest[0] == "[":
            end = rest.index("]", 1) + 1
            out, rest = out + rest[:end], rest[end:]
        elif rest[0] == "(":
            end = _close(rest, 0)
            prefix = re.match(r"\(\?(?:[:=!]|<[=!])|\(", rest).group()
            inner = "|".join(_edges(part) for part in _alternatives(rest[len(prefix):end]))
            out, rest = out + prefix + inner + ")", rest[end + 1:]
        else:
            out, rest = out + rest[0], rest[1:]
    return out


_SHORT_CLASS = (r"\d", r"\s", r"\w")


def _starts(alternative: str) -> tuple[set[str], bool] | None:
    """Members of a character class that hold the first character of every match, and whether a match may be empty.

    None where that is not plain: anchors, negated classes, look-arounds.
    """
    found: set[str] = set()
    for atom, optional in _atoms(alternative):
        if atom == r"\b":
            continue
        if atom.startswith("(") and (atom.startswith("(?:") or not atom.startswith("(?")):
            inner = [_starts(part) for part in _alternatives(atom[3:-1] if atom.startswith("(?:") else atom[1:-1])]
            if any(i is None for i in inner):
                return None
            found |= {member for members, _ in inner for member in members}
            optional = optional or any(empty for _, empty in inner)
        elif atom in _SHORT_CLASS or (atom.startswith("[") and not atom.startswith("[^")):
            found.add(atom)
        elif len(atom) == 1 and atom not in "^$.(":
            found.add(atom if atom.isalnum() else "\\" + atom)
        elif len(atom) == 2 and atom[0] == "\\" and not atom[1].isalnum():
            found.add(atom)
        else:
            return None
        if not optional:
            return found, False
    return found, True


def _looking_ahead(pattern: str, body: str) -> str:
    """``body``, the translated pattern, tried only where the next character may open a match."""
    starts = [_starts(part) for part in _alternatives(pattern)]
    if any(s is None or s[1] for s in starts) or (len(starts) == 1 and r"\b" not in pattern):
        return body
    return f"(?=[{''.join(sorted(set().union(*[members for members, _ in starts])))}])(?:{body})"


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = True) -> str:
    """Translate an ECMAScript-style literal for Spark; case folds beyond ASCII only where the literal needs it."""
    body = "|".join(_edges(part) for part in _alternatives(pattern)) if r"\b" in pattern else pattern
    body = _looking_ahead(pattern, body)
    return ("" if not ignore_case else "(?i)" if pattern.isascii() else "(?iu)") + body


_START_OR_EDGE = r"(?:^|\b)"
_QUANTIFIER = re.compile(r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?")


def _pieces(alternative: str) -> list[str]:
    """The atoms of an alternative with their quantifiers, as written."""
    pieces, i = [], 0
    while i < len(alternative):
        start, ch = i, alternative[i]
        if ch == "\\":
            i += 2
        elif ch == "(":
            i = _close(alternative, i) + 1
        elif ch == "[":
            i = re.compile(r"\[\^?\]?(?:[^\]\\]|\\.)*\]").match(alternative, i).end()
        else:
            i += 1
        quantifier = _QUANTIFIER.match(alternative, i)
        i = quantifier.end() if quantifier else i
        pieces.append(alternative[start:i])
    return pieces


def _shared(alternatives: list[list[str]]) -> str:
    """Alternatives with every common beginning written once; the order of alternatives may change."""
    rests: dict[str, list[list[str]]] = {}
    for first, *rest in filter(None, alternatives):
        rests.setdefault(first, []).append(rest)
    parts = [first + _shared(rest) for first, rest in rests.items()]
    body = "|".join(parts)
    if not all(alternatives):
        return f"(?:{body})?" if body else ""
    return body if len(parts) == 1 else f"(?:{body})"


def _as_tree(pattern: str) -> str:
    """A pattern that matches the same texts, with the alternatives of every plain group as a tree of their beginnings."""

    def inner(piece: str) -> str:
        prefix = re.match(r"\(\?[:=!]|\((?!\?)", piece)
        end = _close(piece, 0) if prefix else -1
        if not prefix or re.fullmatch(r".+\+", piece[end + 1:]):  # what a possessive group takes depends on its order
            return piece
        return prefix.group() + _as_tree(piece[prefix.end():end]) + piece[end:]

    return _shared([[inner(piece) for piece in _pieces(part)] for part in _alternatives(pattern)])


_SPACE_PIECES = (" ", "-", r"\s", r"\s+", "[- ]")


def heads(pattern: str) -> set[str]:
    """Beginnings of words, as patterns, one of which opens every match; empty where a match may begin otherwise."""
    found: set[str] = set()
    for alternative in _alternatives(pattern):
        pieces = _pieces(alternative)
        edge = pieces[:1] == [r"\b"]
        opening = {""} if edge else set()
        for i, piece in enumerate(pieces[1:], 1):
            if len(piece) == 1 and re.fullmatch(r"[A-Za-z0-9_]", piece):
                opening = {head + piece for head in opening}
                continue
            if piece in _SPACE_PIECES:
                opening = {head and head + r"\b" for head in opening}
            elif piece.startswith("(?:") and _close(piece, 0) == len(piece) - 1:
                inner = [heads(r"\b" + part) for part in _alternatives(piece[3:-1])]
                opening = {head + rest for head in opening for rest in set().union(*inner)} if all(inner) else opening
            break
        if not opening or "" in opening:
            return set()
        found |= opening
    return {head for head in found if not any(head != other and head.startswith(other) for other in found)}


@lru_cache(maxsize=None)
def java_test(pattern: str, ignore_case: bool = True) -> str:
    """As :func:`java` for a rule that is only tested: it finds a match in the same texts, but maybe another one."""
    if re.search(r"\\[0-9xupPcNkQE]|\(\?[a-zA-Z>]", pattern):  # escapes of several characters, back references, flags
        return java(pattern, ignore_case)
    if pattern.startswith(_START_OR_EDGE) and _touches_word(pattern[len(_START_OR_EDGE):], False):
        pattern = r"\b" + pattern[len(_START_OR_EDGE):]  # before a word character the start of a text is an edge
    body = "|".join(_edges(part) for part in _alternatives(pattern)) if r"\b" in pattern else pattern
    tree = _as_tree(body.replace(_BEFORE_WORD, r"(?<!\w)").replace(_AFTER_WORD, r"(?!\w)"))  # \w needs no folding of case
    return ("" if not ignore_case else "(?i)" if pattern.isascii() else "(?iu)") + _looking_ahead(pattern, tree)


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """``/pattern/i.test(text)``; a NULL text never matches."""
    return F.coalesce(text.rlike(java_test(pattern, ignore_case)), F.lit(False))


def first_group(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The capture group of the first match, or an empty string."""
    return F.coalesce(F.regexp_extract(text, java(pattern, ignore_case), group), F.lit(""))


def all_groups(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The capture group of every match, in order."""
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def sub(text: Column, pattern: str, replacement: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), replacement)
