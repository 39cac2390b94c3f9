"""Path patterns as regular expressions: shell globs, ``**`` globs and gitignore rules.

Patterns are translated once on the driver; rows are tested by ``rlike`` in the JVM. The expressions use
features that Java, RE2 and Python share, so SQL over the same patterns can serve as an oracle.
"""

from __future__ import annotations

import re

#: A pattern that matches nothing.
NEVER = r"[^\s\S]"


def segment_regex(pattern: str) -> str | None:
    """Regular expression of a shell glob over one path segment; None if the glob is malformed.

    ``*`` and ``?`` stay inside a segment, ``[a-z]`` and ``[^a-z]`` are classes, a backslash escapes.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif c == "[":
            i += 1
            negated = pattern[i : i + 1] == "^"
            i += negated
            body = []
            while i < len(pattern) and (pattern[i] != "]" or not body):
                lo = pattern[i]
                if lo == "\\":
                    i += 1
                    lo = pattern[i : i + 1]
                elif lo in "]-":
                    return None
                if not lo:
                    return None
                i += 1
                hi = lo
                if pattern[i : i + 1] == "-":
                    i += 1
                    hi = pattern[i : i + 1]
                    if hi == "\\":
                        i += 1
                        hi = pattern[i : i + 1]
                    if not hi or hi == "]":
                        return None
                    i += 1
                body.append(re.escape(lo) if lo == hi else f"{re.escape(lo)}-{re.escape(hi)}")
            if i >= len(pattern) or not body:
                return None
            out.append(f"[{'^/' if negated else ''}{''.join(body)}]")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _full(*parts: str | None) -> list[str]:
    return [f"^(?:{p})$" for p in parts if p is not None]


def _folder(name: str) -> str:
    """A path that is a folder of that name or lies in one."""
    return rf"(?:^|/){re.escape(name)}/|^{re.escape(name)}$"


def _anywhere(pattern: str) -> list[str]:
    """Rules for a pattern after ``**/``: the path, its last part, its end, or a part's beginning."""
    glob = segment_regex(pattern)
    plain = re.escape(pattern)
    return _full(glob) + ([f"(?:^|/)(?:{glob})$"] if glob is not None and "/" not in pattern else []) + [f"{plain}$", f"/{plain}"]


def exclusion_regex(pattern: str) -> str:
    """One expression for a simple exclusion pattern (searched in the path)."""
    rules: list[str] = []
    if pattern.endswith("/") and pattern[:-1]:
        rules.append(_folder(pattern[:-1]))
    if pattern.endswith("/**"):
        folder = pattern[:-3].removeprefix("**/")
        if folder:
            rules.append(_folder(folder))
    if pattern.startswith("**/"):
        rules += _anywhere(pattern[3:])
        return "|".join(rules)
    glob = segment_regex(pattern)
    if glob is not None:
        rules += _full(glob)
        if "/" not in pattern:  # any part of the path
            rules.append(f"(?:^|/)(?:{glob})(?:/|$)")
    if pattern.startswith("*."):
        rules.append(re.escape("." + pattern.split(".")[1]) + "$")
    return "|".join(rules) or NEVER


def inclusion_regex(pattern: str) -> str:
    """One expression for a simple inclusion pattern; unlike an exclusion it doesn't test inner parts."""
    rules: list[str] = []
    if pattern.endswith("/") and pattern[:-1]:
        rules.append(_folder(pattern[:-1]))
    if pattern.startswith("**/"):
        rules += _anywhere(pattern[3:])
    glob = segment_regex(pattern)
    if glob is not None:
        rules += _full(glob)
        if "/" not in pattern:
            rules.append(f"(?:^|/)(?:{glob})$")
    if pattern.startswith("*."):
        rules.append(re.escape("." + pattern.split(".")[1]) + "$")
    return "|".join(rules) or NEVER


def _segments_regex(segments: list[str]) -> str | None:
    """Expression over a path's segments, each followed by ``/`` (a slash is appended to the path before)."""
    out = []
    for s in segments:
        if s == "**":
            out.append("(?:[^/]*/)*")
        else:
            one = segment_regex(s)
            if one is None:
                return None
            out.append(f"(?:{one})/")
    return "".join(out)


def gitignore_regex(pattern: str) -> tuple[str | None, str]:
    """An expression the path must have first (or None) and one for a gitignore rule, searched in the path with its leading slash cut and one slash appended.

    A rule with an inner or leading slash holds from the root; one segment from the root matches the path's first
    segment, and so all below it. Without a slash any segment matches. A final slash means folders: the path
    must have a slash, and what follows is free.
    """
    anchored = pattern.startswith("/") or "/" in pattern.removesuffix("/")
    if anchored:
        pattern = pattern.removeprefix("/")
    folders = pattern.endswith("/")
    pattern = pattern.removesuffix("/")
    segments = [s for s in pattern.split("/") if s]
    if not pattern:
        return None, NEVER
    if folders and (not segments or segments[-1] != "**"):
        segments.append("**")
    begin = "^" if anchored else "(?:^|/)"
    if len(segments) == 1 and segments[0] != "**":
        one = segment_regex(segments[0])
        return None, NEVER if one is None else f"{begin}(?:{one})/"
    body = _segments_regex(segments)
    if body is None:
        return None, NEVER
    # a rule for folders needs a path of two segments at least
    return r"/[\s\S]*/" if folders else None, f"{begin}{body}$"


def list_regex(pattern: str) -> str:
    """Expression of a listing glob; with ``**`` it spans folders, else it is one shell glob."""
    if "**" not in pattern:
        return f"^(?:{segment_regex(pattern) or NEVER})$"
    pattern = pattern.replace("\\", "/").strip().removeprefix("./").removeprefix("/").removesuffix("/")
    out = _segments_regex(pattern.split("/"))
    return NEVER if out is None else f"^{out}$"
