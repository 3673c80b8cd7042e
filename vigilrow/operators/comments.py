"""What of a text is code: comments by language, fenced blocks and code spans.

A text is read once, by a pattern whose alternatives are strings and comments, so that the leftmost one wins as it does for a
reader: an opener in a string opens nothing, a quote in a comment neither. Strings end with their line, block comments at their end
or the text's. Marks are put around what is a comment, the text is split at them and comments are blanked part by part. All this is
linear and in one row, without a shuffle or Python, and lines keep their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of files by how their comments are written. Fixed values.
HASH = ("sh", "bash", "zsh", "py", "rb", "pl", "yaml", "yml", "toml", "env")
C_STYLE = ("js", "mjs", "cjs", "ts", "go", "c", "cc", "cpp", "h", "java", "rs")
#: Tags of fences that hold shell code. Fixed values.
SHELL_TAGS = ("sh", "bash", "shell", "zsh", "console")

#: Around a comment; characters for private use, for which another one stands in where the text has them.
OPEN, CLOSE = "\ue000", "\ue001"


def _string(quote: str) -> str:
    return rf"{quote}[^{quote}\\\n]*+(?:\\[^\n][^{quote}\\\n]*+)*+\\?+{quote}?+"


#: (strings)|(comments) of a language, for java.util.regex.
PARTS = {
    "hash": f"({_string(chr(34))}|{_string(chr(39))})|(#[^\\n]*+)",
    "c": f"({_string(chr(34))}|{_string(chr(39))}|{_string('`')})|(//[^\\n]*+|/\\*(?s:.*?)(?:\\*/|\\z))",
}
#: What a text without comments does not hold.
OPENERS = {"hash": ("#",), "c": ("//", "/*")}
FENCE = r"(?m)^[ \t\f\x0B\r]*```"
TAG = r"^`*[ \t]*([A-Za-z]*)"


def re2(pattern: str) -> str:
    """The same pattern without possessive repetitions, which change speed alone here."""
    return pattern.replace("*+", "*").replace("?+", "?").replace("++", "+")


def language(file: str) -> Column:
    """hash, c or md by a file's ending, else null."""
    ending = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)\z", 1))
    return F.when(ending.isin(*HASH), "hash").when(ending.isin(*C_STYLE), "c").when(ending == "md", "md")


def _blanked(part: Column) -> Column:
    """A part up to a mark: its code, and of the comment behind it the line ends."""
    comment = F.when(F.contains(part, F.lit(OPEN)), F.substring_index(part, OPEN, -1)).otherwise("")
    return F.concat(F.substring_index(part, OPEN, 1), F.regexp_replace(comment, r"[^\n]+", ""))


def code_view(text: str, language: str) -> Column:
    """The text with its comments blanked; null where the language has none or nothing opens one."""
    plain = F.translate(text, OPEN + CLOSE, "\ue002\ue002")

    def view(kind: str) -> Column:
        marked = F.regexp_replace(plain, PARTS[kind], f"$1{OPEN}$2{CLOSE}")
        opened = F.contains(F.col(text), F.lit(OPENERS[kind][0]))
        for more in OPENERS[kind][1:]:
            opened = opened | F.contains(F.col(text), F.lit(more))
        return F.when(opened, F.array_join(F.transform(F.split(marked, CLOSE), _blanked), ""))

    return F.when(F.col(language) == "hash", view("hash")).when(F.col(language) == "c", view("c"))


def _bare(line: Column) -> Column:
    return F.translate(line, " \t\r", "")


def comment_lines(text: str, view: str) -> Column:
    """For each line whether it is a comment and nothing else; null where view (from code_view) is."""
    both = F.arrays_zip(F.split(text, "\n").alias("raw"), F.split(view, "\n").alias("code"))
    return F.when(F.col(view).isNotNull(), F.transform(both, lambda x: (_bare(x["code"]) == "") & (_bare(x["raw"]) != "")))


def fence_lines(text: str, shell_only: bool = False) -> Column:
    """For each line whether it stands inside a fence, between its ends; one that is not closed runs to the end of the text.

    Lines behind the last one listed stand in none. shell_only: inside a fence that is tagged as shell.
    """
    parts = F.split(text, FENCE)
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def flags(part: Column, at: Column, last: Column) -> Column:
        inside = at % 2 == 1
        if shell_only:
            inside = inside & F.lower(F.regexp_extract(part, TAG, 1)).isin(*SHELL_TAGS)
        # the line of the fence itself, then the lines up to the next one
        behind = breaks(part) - F.when(at < last, 1).otherwise(0)
        return F.when(at == 0, F.array_repeat(F.lit(False), breaks(part))).otherwise(F.concat(F.array(F.lit(False)), F.array_repeat(inside, behind)))

    # one element, so that the parts are made once
    return F.flatten(F.flatten(F.transform(F.array(parts), lambda p: F.transform(p, lambda s, k: flags(s, k, F.size(p) - 1)))))


def code_only(text: str) -> Column:
    """The fenced lines of a text; all others are blank, so that lines keep their numbers."""
    both = F.arrays_zip(F.split(text, "\n").alias("raw"), fence_lines(text).alias("inside"))
    return F.array_join(F.transform(both, lambda x: F.when(x["inside"], x["raw"]).otherwise("")), "\n")


def strip_code(text: str) -> Column:
    """The text without fenced blocks (of ``` or ~~~, also one that is not closed) and code spans, blanks in their place."""
    prose = F.regexp_replace(text, r"(?s)```+.*?(?:```+|\z)|~~~+.*?(?:~~~+|\z)", "\n")
    return F.regexp_replace(prose, "`[^`]*`", " ")
