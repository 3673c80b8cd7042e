"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width, directional and other characters that are not seen.
INVISIBLE = "­᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"

#: Cyrillic and Greek letters beside the Latin ones that look the same.
LOOKALIKE = ("аеорсухіјѕԁһАВЕКМНОРСТХαονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTXaovABEZHIKMNOPTYX")

#: Where these lie, and more: for tests that cost less than the lists. FAR has all but those of INVISIBLE_ALONE, in one range, which accents are not in.
INVISIBLE_RANGE, LOOKALIKE_RANGE, FAR = r"\u180e\u200b-\u2069", r"\u0370-\u0501", r"\u0370-\u2069"
INVISIBLE_ALONE = ("\u00ad", "\ufeff")

SEVERITIES = ("low", "medium", "high", "critical")
PENALTIES = {"critical": 40, "high": 25, "medium": 12, "low": 5}


def severity_rank(c) -> Column:
    """low 1 to critical 4, anything else 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c) if isinstance(c, str) else c), F.lit(0)).cast("int")


def penalty(c) -> Column:
    rank = severity_rank(c)
    return F.when(rank == 0, 0).otherwise(F.element_at(F.array(*(F.lit(PENALTIES[s]) for s in SEVERITIES)), F.greatest(rank, F.lit(1))))


def step_lower(c: str) -> Column:
    """The next lower severity; low stays."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(severity_rank(c) - 1, F.lit(1)))


def band(score: str) -> Column:
    s = F.col(score)
    return F.when(s >= 85, "Low").when(s >= 70, "Watch").when(s >= 50, "Elevated").otherwise("High")


def strip_invisible(c: str) -> Column:
    return F.regexp_replace(c, f"[{INVISIBLE}]", "")


def normalize(c: str) -> Column:
    """Without invisible characters, look-alike letters made Latin, empty quote pairs and escapes inside words unfolded.

    Cheap tests tell first whether there is anything to change; quotes can become a pair where characters between them go. None
    of them is made twice for a line.
    """
    text = F.col(c)
    wide = F.octet_length(c) != F.length(c)
    # a class of several ranges costs several times as much a character as one range does
    far = text.rlike(f"[{FAR}]") & text.rlike(f"[{INVISIBLE_RANGE}{LOOKALIKE_RANGE}]")
    foreign = wide & reduce(Column.__or__, (text.contains(x) for x in INVISIBLE_ALONE), far)
    paired, escaped = text.contains("''") | text.contains('""'), text.contains("\\")
    plain = F.translate(strip_invisible(c), *LOOKALIKE)
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<=[A-Za-z0-9_])(?:''|\"\")(?=[A-Za-z0-9_])", ""), r"(?<=[A-Za-z0-9_])\\(?=[A-Za-z0-9_])", "")
    return F.when(foreign | paired | escaped, plain).otherwise(text)


def small(c: str) -> Column:
    """In small letters, with the one other letter that counts as an s."""
    return F.replace(F.lower(c), F.lit("ſ"), F.lit("s"))


def estimate_tokens(c: str) -> Column:
    """A quarter of the trimmed characters, rounded up."""
    return F.ceil(F.length(F.trim(c)) / 4).cast("long")


def tokens(c: str) -> Column:
    """The distinct words of three characters and more of [a-z0-9]."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0))))


def jaccard(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def percent(k: str, n: str) -> Column:
    """A whole percentage, halves up; null for n = 0."""
    return F.when(F.col(n) > 0, F.floor(F.col(k) * 100.0 / F.col(n) + 0.5).cast("long"))


def entropy(c) -> Column:
    """Bits per character. A character is counted by what the text is shorter without it."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c)
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def looks_secret(c) -> Column:
    """24 characters or more with a letter and a digit and at least 3.6 bits each."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.length(c) >= 24) & c.rlike("[A-Za-z]") & c.rlike("[0-9]") & (entropy(c) >= 3.6)


def hosts(c: str) -> Column:
    """The distinct lower-case hosts of the URLs in a text, sorted, IPv6 without brackets."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\bhttps?://(?:[^/\s@]*@)?(\[[0-9a-f:]+\]|[A-Za-z0-9.-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda h: F.lower(F.translate(h, "[]", "")))))


def is_loopback(host: Column) -> Column:
    return host.rlike(r"^(?:localhost|127(?:\.[0-9]{1,3}){3}|::1)\z")


def all_loopback(found: str) -> Column:
    return (F.size(found) > 0) & F.forall(found, is_loopback)


#: Parts of names that tell no service.
GENERIC = (
    "api", "com", "net", "org", "io", "www", "co", "dev", "app", "cloud", "ai", "v1", "v2", "v3", "http", "https", "key", "token", "secret", "password",
    "passwd", "apikey", "credential", "credentials", "bearer", "oauth", "auth", "access", "private", "my", "the", "get", "id", "url", "base", "default", "pro", "env",
)


def service_tokens(c: str) -> Column:
    """The telling lower-case parts of a credential's name, of three characters and more."""
    parts = F.array_distinct(F.split(F.lower(c), "[_.-]"))
    return F.filter(F.array_except(parts, F.array(*map(F.lit, GENERIC))), lambda x: F.length(x) > 2)


#: A word of a command line, and the parts of which a word is made: single quotes, double quotes, an escaped character.
SHELL_WORD = r"""(?:[^\t\n\f\r '"\\]++|\\[^\n]|"(?:[^"\\]++|\\[^\n])*+"|'[^']*+')++"""
SHELL_PART = r"""'([^']*+)'|"((?:[^"\\]++|\\[^\n])*+)"|\\([^\n])"""


def shell_word(breakers: str = "") -> str:
    """SHELL_WORD with more characters that end a bare word."""
    return SHELL_WORD.replace("[^\\t", f"[^{breakers}\\t", 1)


#: A word that needs no quotes.
PLAIN_WORD = r"^[A-Za-z0-9_./-]+\z"


def shell_words(c: str, breakers: str = "") -> Column:
    """The words of a command line; quotes go and hold blanks together, and between quotes a backslash is a character as others.

    breakers: characters that part words as blanks do, outside quotes.
    """
    found = F.regexp_extract_all(c, F.lit(shell_word(breakers)), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, SHELL_PART, "$1$2$3"))


def shell_quoted(c: str | Column) -> Column:
    """A path as one word for a shell; plain ones stay as they are."""
    word = F.col(c) if isinstance(c, str) else c
    return F.when(word.rlike(PLAIN_WORD), word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def credential_file(path: str) -> Column:
    """The severity of a file that is a credential by its name, else null. Names and endings are fixed values."""
    base = F.lower(F.regexp_extract(path, "[^/]*\\z", 0))
    high = (".env", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", "credentials", "credentials.json", ".git-credentials", "secrets.yml", "secrets.yaml", ".netrc", ".htpasswd")
    return (
        F.when(base.rlike(r"\.(?:example|sample|template|dist)\z"), F.lit(None))
        .when(base.isin(*high) | base.startswith(".env.") | base.rlike(r"\.(?:key|p12|pfx|jks|keystore)\z"), "high")
        .when(base.isin(".npmrc", ".pypirc") | base.rlike(r"\.pem\z"), "medium")
    )


def inside(path: str, folder: str) -> Column:
    """Whether a path is a folder or lies in it, segment by segment."""
    return (F.col(path) == F.col(folder)) | F.startswith(F.col(path), F.concat(F.regexp_replace(folder, "/+\\z", ""), F.lit("/")))


def clip_bytes(c: str, most: int = 200) -> Column:
    """At most `most` bytes of UTF-8, cut at a character, with an ellipsis where cut."""
    raw = F.encode(F.col(c), "UTF-8")
    head = F.regexp_replace(F.decode(F.substring(raw, 1, most), "ISO-8859-1"), "[À-ÿ][\u0080-¿]{0,3}\\z", "")
    whole = F.decode(F.substring(raw, 1, most), "ISO-8859-1")
    last = F.regexp_extract(whole, "([À-ÿ][\u0080-¿]{0,3})\\z", 1)
    lead = F.ascii(last)
    need = F.when(lead >= 240, 4).when(lead >= 224, 3).otherwise(2)
    cut = F.when((F.length(last) > 0) & (F.length(last) < need), head).otherwise(whole)
    return F.when(F.octet_length(c) <= most, F.col(c)).otherwise(F.concat(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"), F.lit("…")))


def version_key(c: str) -> Column:
    """Three numbers of a version, comparable."""
    parts = F.transform(F.split(F.regexp_extract(c, r"^v?([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: x.try_cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(parts, i), F.lit(0)))


def line_of(text: str, offset: str) -> Column:
    """The line of a character offset, from 1."""
    head = F.substring(F.col(text), F.lit(1), F.col(offset))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def redact(c: str | Column) -> Column:
    """Secrets replaced: URL user data, credential flags, key = value, known token prefixes, user:password flags, then long tokens of high entropy."""
    # what every match holds, in small letters, the pattern and what comes in its place
    steps = (
        (("://",), r"(?i)\b([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1[redacted]@"),
        (("-u",), r"(?<!\S)(-u|--user)([ =])([^\s:]+):\S+", "$1$2$3:[redacted]"),
        (("--password", "--token", "--secret", "--api-key"), r"(?i)(--(?:password|token|secret|api-key))([ =])(?!\[redacted\])\S+", "$1$2[redacted]"),
        (("password", "passwd", "secret", "token", "api"), r"(?i)\b([a-z0-9_-]*(?:password|passwd|secret|token|api[_-]?key)[a-z0-9_-]*)(\s*[=:]\s*)(['\"]?)(?!\[redacted\]|true\b|false\b|null\b|none\b|bearer\b)[^\s'\",;]{4,}", "$1$2$3[redacted]"),
        (("ghp_", "gho_", "sk-", "xox", "akia"), r"\b(?:ghp_|gho_|sk-|xox[abp]-|AKIA)[A-Za-z0-9_-]{12,}", "[redacted]"),
    )
    # one element, so that a text that is looked at twice is made once
    out = F.array(F.col(c) if isinstance(c, str) else c)
    for words, pattern, by in steps:
        out = F.transform(out, _replaced(words, pattern, by))
    return F.get(F.transform(out, redact_entropy), F.lit(0))


def _replaced(words: tuple[str, ...], pattern: str, by: str):
    return lambda x: F.when(_holds(x, words), F.regexp_replace(x, pattern, by)).otherwise(x)


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, which are in small letters."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words)))


def redact_entropy(c: Column) -> Column:
    """Tokens that look secret without their padding replaced."""
    parts = F.regexp_extract_all(c, F.lit("[A-Za-z0-9+/_-]+={0,2}|[^A-Za-z0-9+/_-]+"), F.lit(0))
    plain = F.transform(parts, lambda x: F.when(looks_secret(F.regexp_replace(x, "=+\\z", "")) & x.rlike("^[A-Za-z0-9+/_-]"), "[redacted]").otherwise(x))
    return F.when(c.rlike("[A-Za-z0-9+/_-]{24}"), F.array_join(plain, "")).otherwise(c)


def scrub_paths(c: str) -> Column:
    """Home folders replaced by ~."""
    return F.regexp_replace(c, r"(?<![A-Za-z0-9_])/(?:home|Users)/[A-Za-z0-9._-]+", "~")


def wilson(k: str, n: str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of the 95 % interval of k of n; null for n = 0."""
    p, m = F.col(k) / F.col(n), F.col(n)
    centre, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(m > 0, (centre - spread) / (1 + z * z / m)), F.when(m > 0, (centre + spread) / (1 + z * z / m))
