"""Patterns in RE2 syntax, translated for java.util.regex so that both give the same matches."""

from __future__ import annotations

_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_OUTSIDE = {"s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "b": _BOUNDARY, "d": "[0-9]", "D": "[^0-9]", "w": "[A-Za-z0-9_]", "W": "[^A-Za-z0-9_]", "z": r"\z", "A": r"\A"}
_INSIDE = {"s": r"\t\n\f\r ", "d": "0-9", "w": "A-Za-z0-9_"}


def re2_to_java(pattern: str) -> str:
    """`$`, `.`, `(?i)`, white space, word boundaries and class operators with RE2's meaning."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            known = _INSIDE if inside else _OUTSIDE
            out.append(known.get(pattern[at + 1], pattern[at : at + 2]))
            at += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[":
                c = r"\["
            elif c == "&":
                c = r"\&"
        elif c == "[":
            inside = True
            for more in ("^", "]"):
                if pattern.startswith(more, at + 1):
                    c += "^" if more == "^" else r"\]"
                    at += 1
        elif c == "$":
            c = r"\z"
        elif c == ".":
            c = r"[^\n]"
        elif pattern.startswith("(?i)", at):
            c, at = "(?iu)", at + 3
        out.append(c)
        at += 1
    return "".join(out)


def glob_to_re2(glob: str) -> str:
    """A path glob: `*` within a folder, `**` across folders, `?` one character; `dir/**` has dir itself too."""
    out, at = ["^"], 0
    while at < len(glob):
        if glob[at:] == "/**":
            out.append("(?:/.*)?")
            break
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            c = glob[at]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r"\.+()[]{}^$|" else c))
            at += 1
    return "".join(out) + "$"
