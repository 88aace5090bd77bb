"""Translate ECMAScript regular expressions to the dialect of Spark's engine.

The rule tables are written with ECMAScript semantics in mind.  Java differs
in four places that matter on real text: ``\\b`` may be Unicode-aware, ``\\s``
misses the Unicode spaces, ``$`` also matches before a final newline and
``[^]`` is not a class.  Every pattern goes through :func:`js` once, on the
driver, so the executors only ever see a literal, pre-compiled pattern.
"""

from __future__ import annotations

from functools import lru_cache

#: Characters ECMAScript counts as white space beyond Java's ``\s``.
_EXTRA_SPACE = r"\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = rf"[\s{_EXTRA_SPACE}]"
_NOT_SPACE = rf"[^\s{_EXTRA_SPACE}]"
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


@lru_cache(maxsize=None)
def js(pattern: str, flags: str = "") -> str:
    """Return a Java pattern equivalent to ``/pattern/flags`` (g is implied)."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            token = pattern[i : i + 2]
            if token == r"\s":
                out.append(rf"\s{_EXTRA_SPACE}" if in_class else SPACE)
            elif token == r"\S" and not in_class:
                out.append(_NOT_SPACE)
            elif token == r"\b" and not in_class:
                out.append(_EDGE)
            else:
                out.append(token)
            i += 2
            continue
        if not in_class and pattern.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        if ch == "[":
            # Java treats a nested "[" as a class union; ECMAScript does not.
            out.append(r"\[" if in_class else ch)
            in_class = True
        elif ch == "]" and in_class:
            out.append(ch)
            in_class = False
        elif ch == "&" and in_class:
            out.append(r"\&")
        elif ch == "$" and not in_class and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    keep = "".join(f for f in flags if f in "im")
    return (f"(?{keep})" if keep else "") + "".join(out)


def any_of(patterns: list[str], flags: str = "") -> str:
    """One alternation over several ECMAScript patterns."""
    return js("|".join(f"(?:{p})" for p in patterns), flags)


def quote(text: str) -> str:
    """Escape a literal for use inside a pattern."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in text)


def glob(pattern: str, anchored: bool = True, dots_literal: bool = True) -> str:
    """A ``*`` glob as a pattern.

    ``dots_literal=False`` keeps ``.`` as "any character", which is how the
    configured PHI path globs behave.
    """
    special = r"+?^${}()|[]\ ".strip() + ("." if dots_literal else "")
    body = "".join(
        ".*" if c == "*" else ("\\" + c if c in special else c) for c in pattern
    )
    return rf"^{body}\z" if anchored else body


def path_glob(pattern: str) -> str:
    """A file-system style glob: ``*`` stays in one segment, ``**`` crosses.

    Brace lists ``{a,b}`` are alternatives; ``*`` does not match a leading dot.
    """
    out: list[str] = []
    i = 0
    depth = 0
    while i < len(pattern):
        start = i == 0 or pattern[i - 1] == "/"
        if pattern.startswith("**/", i) and start:
            out.append(r"(?:(?!\.)[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i) and start and i + 2 == len(pattern):
            out.append(r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)?")
            i += 2
        elif pattern[i] == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            alone = start and (i == len(pattern) or pattern[i] == "/")
            out.append((r"(?!\.)" if start else "") + ("[^/]+" if alone else "[^/]*"))
        elif pattern[i] == "?":
            out.append((r"(?!\.)" if start else "") + "[^/]")
            i += 1
        elif pattern[i] == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif pattern[i] == "}" and depth:
            depth -= 1
            out.append(")")
            i += 1
        elif pattern[i] == "," and depth:
            out.append("|")
            i += 1
        elif pattern[i] == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body.startswith("!") else body
            out.append(f"[{body}]")
            i = end + 1
        else:
            out.append(quote(pattern[i]))
            i += 1
    return "^" + "".join(out) + r"\z"
