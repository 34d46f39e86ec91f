"""RE2 patterns for the JVM: translation, refusal of dangerous ones, required literals, offsets of groups."""

from __future__ import annotations

import re
import warnings

_SPACE = r"\t\n\f\r "
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_NO_EDGE = "(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: An edge before what can only be a letter, digit or underscore is the absence of one before it.
_BEFORE_WORD = "(?<![A-Za-z0-9_])"
_WORD_NEXT = re.compile(r"(?:\((?:\?:)?)*(?:[A-Za-z0-9_](?![*?{|])|\[(?:[A-Za-z0-9_](?:-[A-Za-z0-9])?)+\](?![*?]|\{0))")
#: Shapes of patterns that are refused, and the deepest nesting of brackets.
_DANGEROUS = (
    r"\(\s*[^)]+\s*\+\s*\)\s*\+", r"\(\s*[^)]+\s*\*\s*\)\s*\*", r"\(\s*[^)]+\s*\+\s*\)\s*\{", r"\(\s*[^)]+\s*\*\s*\)\s*\+",
    r"\+\s*\+", r"\*\s*\*", r"\?\s*\+", r"\+\s*\?", r"\*\s*\+", r"\+\s*\*",
)
DEEPEST = 5


class Unsupported(ValueError):
    """A pattern that RE2 does not compile or that cannot be expressed here."""


def is_dangerous(pattern: str) -> bool:
    if any(re.search(d, pattern, re.ASCII) for d in _DANGEROUS):
        return True
    depth = deepest = 0
    for c in pattern:
        depth += (c in "([{") - (c in ")]}")
        deepest = max(deepest, depth)
    return deepest > DEEPEST


def _class(pattern: str, at: int) -> tuple[str, int]:
    """A bracketed class from its [ on: its text for the JVM and where it ends."""
    out, k = ["["], at + 1
    if pattern[k : k + 1] == "^":
        out.append("^")
        k += 1
    first = True
    while k < len(pattern) and (pattern[k] != "]" or first):
        first = False
        c = pattern[k]
        if c == "\\":
            n = pattern[k + 1 : k + 2]
            out.append({"s": _SPACE, "S": f"[^{_SPACE}]"}.get(n, c + n))
            k += 2
        elif m := re.match(r"\[:(\^?)(\w+):\]", pattern[k:]):
            name = {"word": "w"}.get(m[2])
            out.append((rf"\{name}" if name else rf"\p{{{m[2].capitalize() if m[2] != 'xdigit' else 'XDigit'}}}") if not m[1] else rf"\P{{{m[2].capitalize()}}}")
            k += len(m[0])
        else:
            out.append("\\" + c if c in "[&" else c)
            k += 1
    if k >= len(pattern):
        raise Unsupported("a class is not closed")
    return "".join(out) + "]", k + 1


def to_java(pattern: str) -> str:
    """The same matches, leftmost-first and by RE2's ASCII classes, in java.util.regex syntax."""
    plain = re.sub(r"\\[pP](?:\{\^?\w+\}|\w)|\\[zC]", "x", re.sub(r"\[:\^?\w+:\]", "x", pattern))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(plain)
    except (re.error, OverflowError, RecursionError) as e:
        raise Unsupported(str(e)) from None
    out: list[str] = []
    k, multi, dot = 0, False, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            n = pattern[k + 1 : k + 2]
            if n in "123456789" or n in ("C", "G", "Z", "k") or not n:
                raise Unsupported(f"\\{n}")
            if n == "b" and _WORD_NEXT.match(pattern, k + 2):
                n = "b<"
            out.append({"b<": _BEFORE_WORD, "b": _EDGE, "B": _NO_EDGE, "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]"}.get(n, c + n))
            k += 2
        elif c == "[":
            text, k = _class(pattern, k)
            out.append(text)
        elif m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", pattern[k:]):
            if "U" in m[1] + (m[2] or ""):
                raise Unsupported("ungreedy flag")
            multi, dot = ("m" in m[1] or multi) and "m" not in (m[2] or ""), ("s" in m[1] or dot) and "s" not in (m[2] or "")
            on = "".join({"i": "iu", "m": "md", "s": "s"}[f] for f in m[1])
            out.append(f"(?{on}{'-' + m[2] if m[2] else ''}{m[3]}")
            k += len(m[0])
        elif m := re.match(r"\(\?P?<([A-Za-z]\w*)>", pattern[k:]):
            out.append(f"(?<{m[1].replace('_', '')}>")
            k += len(m[0])
        elif pattern.startswith("(?", k) and pattern[k + 2 : k + 3] != ":":
            raise Unsupported(pattern[k : k + 4])
        elif c in "*+?" or (m := re.match(r"\{(\d+)(,(\d*))?\}", pattern[k:])):
            size = 1
            if c == "{":
                size = len(m[0])
                if max(int(m[1]), int(m[3] or 0)) > 1000:
                    raise Unsupported("more than 1000 repeats")
            follow = pattern[k + size : k + size + 1]
            if follow in ("*", "+") or re.match(r"\{\d+(,\d*)?\}", pattern[k + size :]):
                raise Unsupported("nested repetition")
            out.append(pattern[k : k + size] + ("?" if follow == "?" else ""))
            k += size + (follow == "?")
        elif c == "$":
            out.append("$" if multi else r"\z")
            k += 1
        elif c == ".":
            out.append("." if dot else r"[^\n]")
            k += 1
        else:
            out.append(c)
            k += 1
    return "".join(out)


def with_prefix_group(pattern: str, group: int) -> str | None:
    """The pattern with all that stands before a top-level capture group in a group of its own, which comes first, so
    old group g is g + 1; None where the group is not at top level or alternatives are."""
    flags = re.match(r"\(\?[ims]+\)", pattern)
    begun = flags.end() if flags else 0
    depth = number = 0
    k, at = begun, None
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if c == "[":
            k = _class(pattern, k)[1]
            continue
        if c == "(":
            if pattern[k + 1 : k + 2] != "?" or pattern.startswith("(?P<", k):
                number += 1
                if number == group:
                    if depth:
                        return None
                    at = k
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return None
        k += 1
    return None if at is None else f"{pattern[:begun]}({pattern[begun:at]}){pattern[at:]}"


def groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?(?!P?<[A-Za-z]))", re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "_", pattern)))


def _tree(pattern: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return re._parser.parse(pattern)
        except (re.error, OverflowError):
            return None


def longest_run(pattern: str, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") -> int:
    """So many characters in a row out of these letters every match has at least."""
    tree = _tree(pattern)
    if tree is None or tree.state.flags & re.IGNORECASE:
        return 0
    allowed = set(map(ord, letters))

    def inside(op, arg) -> bool:
        if str(op) == "LITERAL":
            return arg in allowed
        if str(op) != "IN":
            return False
        return all((str(o) == "LITERAL" and a in allowed) or (str(o) == "RANGE" and set(range(a[0], a[1] + 1)) <= allowed) for o, a in arg)

    def of(items) -> int:
        best = run = 0
        for op, arg in items:
            name = str(op)
            if inside(op, arg):
                run += 1
            elif name == "MAX_REPEAT" and len(arg[2]) == 1 and inside(*arg[2][0]):
                run += arg[0]
            else:
                run = 0
                if name == "SUBPATTERN":
                    best = max(best, of(arg[-1]))
                elif name == "BRANCH":
                    best = max(best, min(of(p) for p in arg[1]))
            best = max(best, run)
        return best

    return of(tree)


def required(pattern: str, shortest: int = 3) -> tuple[list[str], bool] | None:
    """(literals, case-folded): every match holds one of them. None where no useful ones are found.

    Folded literals are in lower case, to be sought in text made lower with the long s as s; Kelvin's sign is a k there.
    """
    tree = _tree(pattern)
    if tree is None:
        return None
    folded = bool(tree.state.flags & re.IGNORECASE)

    def better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
        if not a or not b:
            return a or b
        return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))

    def of(items) -> list[str] | None:
        best, run = None, []
        for op, arg in [*items, (None, None)]:
            if str(op) == "LITERAL":
                run.append((op, arg))
                continue
            before, run = run, []
            if before:
                best = better(best, ["".join(chr(c) for _, c in before)])
            name = str(op)
            if name == "SUBPATTERN":
                inner = list(arg[-1])
                best = better(best, of([*before, *inner] if before and inner and str(inner[0][0]) in ("LITERAL", "BRANCH") else inner))
            elif name == "BRANCH":  # the parser takes what alternatives begin with alike out of them
                parts = [of([*before, *p]) for p in arg[1]]
                if all(parts):
                    best = better(best, [x for p in parts for x in p])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                best = better(best, of(arg[2]))
        return best

    found = of(tree)
    if not found or min(map(len, found)) < (shortest if folded else min(shortest, 2)):
        return None
    return ([x.lower() for x in found], True) if folded else (found, False)
