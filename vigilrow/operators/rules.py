"""Line rules: a table of patterns, evaluated on logical lines under the gate of role and rule."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilrow.functions.regex import re2_to_java
from vigilrow.functions.scalar import normalize, small
from vigilrow.operators.comments import code_view, comment_lines, fence_lines, language
from vigilrow.operators.layout import quoted_as_example


@dataclass(frozen=True)
class Rule:
    id: str
    dimension: int
    severity: str
    pattern: str  # RE2
    needs: tuple[str, ...] = ()  # every match holds one of these, in small letters; none: not known
    marked: bool = False  # every match holds one of MARKS
    near: str = ""  # a cheap pattern (java) that the view in small letters has wherever the rule matches
    scope: str = ""  # script, hook or connector: only there
    veto: str = ""
    raw_only: bool = False  # only on the raw view, for characters beyond ASCII
    advisory: bool = False


#: Characters that prose seldom has; most rules ask for one of them.
MARKS = r"[(=|/$@;&<>`~\\%]"


def _rule(id, dimension, severity, pattern, *needs, **more) -> Rule:
    return Rule(id, dimension, severity, "(?i)" + pattern, needs, **more)


#: Ids, dimensions and severities are fixed values; the patterns are our own.
RULES = (
    _rule("INJ-001", 1, "high", r"\b(?:ignore|disregard|forget)\b.{0,20}\b(?:previous|prior|earlier|above)\b.{0,20}\b(?:instructions?|rules|orders)\b", "instruction", "rules", "orders"),
    _rule("INJ-002", 1, "medium", r"\b(?:ignore|disregard|override)\b.{0,20}\b(?:system|developer)\b.{0,10}\b(?:prompt|message)\b", "prompt", "message"),
    _rule("INJ-003", 1, "medium", r"\byou are now\b.{0,30}\b(?:unrestricted|jailbroken|without limits)\b", "you are now"),
    _rule("INJ-004", 1, "medium", "[​‌‍‪‫‭‮⁠⁦⁧⁨]", raw_only=True, near=r"[​-⁩]"),
    _rule("INJ-005", 1, "high", r"\b(?:curl|wget|fetch)\b.*https?://\S+/(?:instructions|steps|payload|prompt)\.(?:md|txt)\b", "://", marked=True),
    _rule("EXEC-001", 4, "high", r"\bcurl\b.*\|\s*(?:sudo\s+(?:-\S+\s+)*)?(?:/(?:usr/)?bin/)?(?:ba|z|da|k)?sh\b", "curl", marked=True),
    _rule("EXEC-002", 4, "high", r"\bwget\b.*\|\s*(?:sudo\s+(?:-\S+\s+)*)?(?:/(?:usr/)?bin/)?(?:ba|z|da|k)?sh\b", "wget", marked=True),
    _rule("EXEC-003", 4, "low", r"(?:^|[^\w.])(?:eval|exec)\s*\(", "eval", "exec", marked=True),
    _rule("EXEC-004", 4, "medium", r"\bsubprocess\.[a-z_]+\s*\(|\bos\.(?:system|popen)\s*\(|\brequire\(\s*['\"](?:node:)?child_process|\bshell\s*=\s*true\b", "subprocess", "os.", "child_process", "shell", marked=True),
    _rule("EXEC-005", 4, "medium", r"\bnew\s+function\s*\(", "function", marked=True),
    # a timer that is given text: called by name or by key, with a literal or one that is put together
    _rule("EXEC-006", 4, "medium", r"\bset(?:timeout|interval)(?:['\"]\s*\])?\s*\(\s*(?:[\w$.]+\s*\+\s*)?['\"`]", "settimeout", "setinterval", marked=True),
    _rule("EXEC-007", 4, "medium", r"\bvm\.(?:run|compile|create)[a-z]*(?:context|function|script)\b|\bnew\s+vm\.script\b", "vm."),
    _rule("EXEC-008", 4, "high", r"\bpowershell\b.{0,80}\s-e(?:nc|ncodedcommand)?\s+[a-z0-9+/=]{16,}", "powershell"),
    _rule("EXEC-009", 4, "medium", r"\b(?:invoke-expression|iex)\b\s*[\(\$'\"]", "invoke-expression", "iex"),
    _rule("EXEC-010", 4, "high", r"\b(?:ld_preload|dyld_insert_libraries|pythonstartup|node_options|bash_env)\s*=", "ld_preload", "dyld_insert_libraries", "pythonstartup", "node_options", "bash_env", marked=True),
    _rule("EXEC-011", 4, "high", r"\bbase64\b\s+(?:-d|--decode)\b[^|]{0,80}\|\s*(?:ba|z)?sh\b", "base64", marked=True),
    _rule("EXEC-012", 4, "high", r"(?:\$\(|`|<\()\s*(?:curl|wget)\b", "curl", "wget", marked=True),
    _rule("EXEC-013", 4, "high", r"(?:source|\.)\s+/tmp/[^\s]+.{0,40}>>\s*~?/?[^\s]*\.(?:bashrc|zshrc|profile)\b", "/tmp/", marked=True),
    _rule("HOOK-001", 4, "medium", r"(?:&&|\|\||;)\s*\w", "&&", "||", ";", scope="hook", marked=True),
    _rule("EXFIL-004", 3, "medium", r"(?:\bprintenv\b|(?:^|[;&|]\s*)env\s*(?:$|[|>])|\bos\.environ\.(?:items|copy)\(|json\.dumps\(\s*(?:dict\()?os\.environ)", "env", near=r"printenv|os\.environ|env[\t\n\f\r ]*(?:\z|[|>])"),
    _rule("EXFIL-006", 3, "medium", r"\b[a-z_]*(?:base_url|api_base|endpoint)\s*[=:]\s*['\"]?https?://", "://", veto=r"https?://(?:api\.[a-z]+\.(?:com|org)|localhost|127\.)", marked=True),
    # a query parameter whose value names the machine or its user: by a command, or by a variable of the shell
    _rule("EXFIL-007", 3, "high", r"[?&][\w.%-]*=\S*?(?:(?:\$\(|`)\s*(?:(?:hostname|whoami|uname|ifconfig|id|logname)\b|cat\s+/etc/machine-id)|\$\{?(?:hostname|user|logname)\b)", "hostname", "whoami", "uname", "ifconfig", "id", "logname", "user", marked=True),
    _rule("PERM-007", 2, "high", r"(?:>|>>|write(?:_text|filesync)?\s*\().{0,60}settings(?:\.local)?\.json", "settings", scope="script", marked=True),
    _rule("PERM-008", 2, "medium", r"['\"]?(?:permissiondecision|decision|behavior)['\"]?\s*:\s*['\"]allow['\"]", "allow", scope="script"),
    _rule("MCP-001", 1, "high", r"\b(?:read|include|send|attach)\b.{0,60}(?:~/\.ssh|id_rsa|\.env\b|credentials|api keys?)", "read", "include", "send", "attach", scope="connector"),
    _rule("MCP-002", 1, "medium", r"\b(?:do not|never) (?:tell|mention|inform|show)\b.{0,20}\buser\b|\binstead of (?:the )?other tools?\b", "user", "instead of", scope="connector"),
    _rule("MCP-003", 1, "medium", r"^\s*(?:<(?:important|system)>|system\s*:)", "<important>", "<system>", "system", scope="connector"),
    _rule("MCP-004", 3, "medium", r"\b(?:send|post|forward|upload)\b.{0,60}https?://", "://", scope="connector", marked=True),
    _rule("MCP-005", 3, "high", r"\b(?:always )?(?:bcc|cc|copy)\b.{0,40}[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "@", scope="connector", marked=True),
    _rule("SUP-001", 5, "medium", r"\bpip3?\s+install\b.*--(?:extra-)?index-url\b", "index-url"),
    # a package from a place without a certificate: any client, any form of the address
    _rule("SUP-002", 5, "medium", r"\b(?:npm|pnpm|yarn)\s(?:[^;|&]*\s)?(?:install|add|ci|i)\s(?:[^;|&]*\s)?['\"]?(?:[@\w./-]+@)?(?:git\+http|git|http)://", "npm", "yarn", marked=True),
    _rule("SUP-003", 5, "low", r"\b(?:pip3?|npm)\s+(?:i|install)\s+[a-z][a-z0-9_-]*\s*$", "pip", "npm"),
    _rule("SUP-007", 5, "high", r"\b(?:curl|wget)\b.{0,80}\s-o\s*\S*.{0,40}http://", "http://", veto=r"http://(?:localhost|127\.)", marked=True),
    _rule("OBF-001", 6, "medium", r"\b(?:base64\s+(?:-d|--decode)|b64decode|atob)\b", "base64", "b64decode", "atob"),
    _rule("OBF-002", 6, "low", r"[a-z0-9+/]{200,}={0,2}", near=r"(?:^|[ .,])[^ .,]{200}"),
    _rule("OBF-003", 6, "medium", r"\b(?:eval|exec)\s*\(.{0,40}\b(?:b64decode|atob|fromhex|unhexlify)\b", "eval", "exec", marked=True),
    _rule("OBF-005", 6, "medium", "[a-z][Ͱ-ϿЀ-ӿ]|[Ͱ-ϿЀ-ӿ][a-z]", raw_only=True, near=r"[\u00b5\u0345-\uffff]"),
    _rule("FS-001", 9, "high", r"(?:~|/root|/home/\w+)/\.ssh/(?:id_\w+|authorized_keys)", ".ssh/", marked=True),
    _rule("FS-002", 9, "medium", r"(?:\.aws/credentials|\.config/gcloud|\.azure/|\.kube/config)", ".aws/", ".config/gcloud", ".azure/", ".kube/", marked=True),
    _rule("FS-003", 9, "high", r"\brm\s+-(?:rf|fr|r\s+-f)\s+(?:/|~|\$home)(?:\s|\*|$)", "rm", marked=True),
    # two steps up or more, plain or percent-encoded, and then a folder of the system
    _rule("FS-004", 9, "medium", r"(?:(?:\.|%2e){2}(?:[/\\]|%2f|%5c)+){2,}(?:etc|proc|root|home|users|var|windows)(?:[/\\]|%2f|%5c|\b)", "..", "%2e", marked=True),
    _rule("FS-005", 9, "high", r"(?:\bhistory\s+-c\b|\brm\b.{0,30}(?:bash|zsh)_history|\btruncate\b.{0,40}/var/log/)", "history", "truncate"),
    _rule("RES-001", 8, "low", r"\bwhile\s*\(?\s*(?:true|1)\b", "while", advisory=True),
    _rule("RES-002", 8, "low", r"\bfor\s*\(\s*;\s*;\s*\)", "for", advisory=True, marked=True),
    _rule("RES-003", 8, "low", r"\bretry\b.{0,20}\b(?:forever|indefinitely|until it works)\b", "retry", advisory=True),
    _rule("BD-001", 7, "medium", r"\bif\b.{0,60}\b(?:hostname|getuser|datetime\.now|date\.now)\b", "hostname", "getuser", "datetime.now", "date.now", advisory=True),
    _rule("BD-002", 7, "medium", r"(?:\bchr\s*\(\s*[0-9]+\s*\)\s*[+.]\s*){2,}|string\.fromcharcode\s*\(", "chr", "fromcharcode", advisory=True, marked=True),
    _rule("BD-003", 7, "low", r"\b(?:reverse shell|bind shell|netcat)\b", "shell", "netcat", advisory=True, veto=r"/dev/tcp/|\bnc\b.{0,20}-e\b"),
    _rule("BD-004", 7, "high", r"(?:bash|sh)\s+-i\b.{0,20}/dev/tcp/|\bnc\b.{0,40}\s-e\s*/bin/", "/dev/tcp/", "/bin/", advisory=True, marked=True),
)

#: Which lines a rule may see: role to (ordinary rules of dimension 1, other ordinary rules, own scopes). Fixed values.
GATE = {
    "script": (True, True, ("script",)),
    "instruction": (True, True, ()),
    "doc": (True, False, ()),
    "hook": (True, True, ("script", "hook")),
    "connector": (True, False, ("connector",)),
    "code": (False, True, ()),
}


def gates() -> list[tuple[str, str]]:
    """(role, rule) pairs that the gate lets through."""
    return [(role, r.id) for role, (first, other, scopes) in GATE.items() for r in RULES if (r.scope in scopes if r.scope else first if r.dimension == 1 else other)]


#: Injection phrases that may be quoted to refuse them. Fixed values.
PHRASES = ("INJ-001", "INJ-002", "INJ-003")


def lines(units: DataFrame) -> DataFrame:
    """units (unit, role, file, text, ...) to one row per logical line: line (of its first physical line, from 1), raw, comment, norm.

    A physical line that ends in an odd number of backslashes goes on in the next one: in files of shell and its like unless it is a
    comment, in hooks, and in fences of Markdown that are tagged as shell. comment: the line is a comment of its file's language.
    """
    keep = [c for c in units.columns if c != "text"]
    plain = F.lit(None).cast("array<boolean>")
    known = once(units, _language=language("file"))
    known = once(known, _parts=F.split("text", "\n"), _view=code_view("text", "_language"))
    goes_on = F.contains("text", F.lit("\\\n"))
    fenced = F.when(goes_on & (F.col("_language") == "md"), fence_lines("text", shell_only=True)).otherwise(plain)
    known = once(known, _comment=comment_lines("text", "_view"), _fenced=fenced, _folds=goes_on & ((F.col("role") == "hook") | (F.coalesce("_language", F.lit("")) == "hash")))
    # (line, raw, comment) of each logical line; texts in which no line goes on need no folding
    folded = F.expr(r"""if(not (_folds or _fenced is not null), transform(_parts, (x, i) -> struct(i + 1 as line, x as raw, coalesce(get(_comment, i), false) as comment)),
      transform(array(filter(sequence(0, size(_parts) - 1), i -> i = 0 or not (_parts[i - 1] rlike r'(?<!\\)(?:\\\\)*\\\z'
        and (_folds and not coalesce(get(_comment, i - 1), false) or coalesce(get(_fenced, i - 1), false))))), starts -> transform(starts, (s, k) -> struct(s + 1 as line,
          regexp_replace(array_join(slice(_parts, s + 1, coalesce(get(starts, k + 1), size(_parts)) - s), '\n'), r'\\\n', '') as raw, coalesce(get(_comment, s), false) as comment)))[0])""")
    out = known.select(*keep, F.inline(folded))
    return once(out, norm=normalize("raw"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once a row, however often they are used behind."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _near(rule: Rule, view: str) -> Column | None:
    """What every match of the rule holds but for MARKS; None: not known."""
    tests = [F.octet_length(view) != F.length(view)] if rule.raw_only else []
    tests += [reduce(Column.__or__, (F.col(f"{view}_small").contains(x) for x in rule.needs))] if rule.needs else []
    tests += [F.col(f"{view}_small").rlike(rule.near)] if rule.near else []
    return reduce(Column.__and__, tests) if tests else None


def _matches(rule: Rule, view: str) -> Column:
    found = F.col(view).rlike(re2_to_java(rule.pattern))
    if rule.veto:
        found = found & ~F.col(view).rlike(re2_to_java(rule.veto))
    # the cheap tests come first
    near = _near(rule, view)
    found = found if near is None else near & found
    return F.col(f"{view}_marked") & found if rule.marked else found


#: So many rules are in one step: what Spark compiles of a step stays small enough to be compiled.
STEP = 6


def evaluate(lines_df: DataFrame) -> DataFrame:
    """Lines that a rule matches: the raw view first, else the normalised one; a veto counts on the same view.

    Matches on whole comment lines are dropped but for dimensions 0 and 6, and so are, outside scripts, injection phrases that are quoted as
    an example. Patterns are literals of one projection, each behind
    tests for what every match holds (a mark of code, a word, a cheap pattern), so that most lines meet no pattern at all.
    """
    roles: dict[str, list[str]] = {}
    for role, rule in gates():
        roles.setdefault(rule, []).append(role)
    other = F.col("norm") != F.col("raw")
    rows = once(lines_df, raw_small=small("raw"), raw_marked=F.col("raw").rlike(MARKS))
    # most lines can match nothing and go first
    hints: dict[tuple[str, ...], list[Column]] = {}
    for r in RULES:
        if r.id in roles and not r.marked:
            near = _near(r, "raw")
            hints.setdefault(tuple(roles[r.id]), []).append(F.lit(True) if near is None else near)
    hint = reduce(Column.__or__, (F.col("role").isin(*seen) & reduce(Column.__or__, near) for seen, near in hints.items()), other | F.col("raw_marked"))
    rows = once(rows.filter(hint), norm_small=F.when(other, small("norm")), norm_marked=F.when(other, F.col("norm").rlike(MARKS)))
    none, steps = F.lit(0).cast("long"), range(0, len(RULES), STEP)
    for at in steps:
        raw = norm = none
        for k, r in list(enumerate(RULES))[at : at + STEP]:
            if r.id in roles:
                bit, seen = F.lit(1 << k).cast("long"), F.col("role").isin(*roles[r.id])
                if r.dimension not in (0, 6):
                    seen = seen & ~F.col("comment")
                raw = raw.bitwiseOR(F.when(seen & _matches(r, "raw"), bit).otherwise(none))
                if not r.raw_only:
                    norm = norm.bitwiseOR(F.when(other & seen & _matches(r, "norm"), bit).otherwise(none))
        rows = once(rows, **{f"raw_{at}": raw, f"norm_{at}": norm})
    # a bit for each rule; few lines have any
    hits_of = lambda view: reduce(Column.bitwiseOR, (F.col(f"{view}_{at}") for at in steps))
    found = once(rows, raw_hits=hits_of("raw"), norm_hits=hits_of("norm")).filter(F.col("raw_hits").bitwiseOR(F.col("norm_hits")) != 0)
    known = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(r.id).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.lit(r.advisory).alias("advisory")) for k, r in enumerate(RULES)))
    hit = F.filter(known, lambda x: x["bit"].bitwiseAND(F.col("raw_hits").bitwiseOR(F.col("norm_hits"))) != 0)
    view = F.when(F.col("bit").bitwiseAND(F.col("raw_hits")) != 0, "raw").otherwise("norm")
    hits = found.select("*", F.inline(hit)).withColumn("view", view)
    seen = F.when(F.col("view") == "raw", F.col("raw")).otherwise(F.col("norm"))
    example = reduce(lambda rest, r: F.when(F.col("rule") == r.id, quoted_as_example(seen, re2_to_java(r.pattern))).otherwise(rest), (r for r in RULES if r.id in PHRASES), F.lit(False))
    return hits.filter((F.col("role") == "script") | ~example).drop("raw_small", "norm_small", "raw_marked", "norm_marked", "raw_hits", "norm_hits", "bit", *(f"{view}_{at}" for view in ("raw", "norm") for at in steps))


def fingerprint() -> str:
    """12 hex digits over all fields of all rules, each with its length."""
    import hashlib

    fields = (str(x) for r in RULES for x in (r.id, r.dimension, r.severity, r.pattern, r.scope, r.veto, r.raw_only, r.advisory))
    return hashlib.sha256("".join(f"{len(x.encode())}:{x}" for x in fields).encode()).hexdigest()[:12]
