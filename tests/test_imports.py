"""The import graph against a breadth-first search that keeps everything in memory."""

import posixpath
import random
import re

from vigilrow.functions import paths
from vigilrow.operators import imports


def search(files: dict, seeds: list, known: list, home: str) -> dict:
    """path: (depth, importer, ref, state, severity) of one root."""
    refs = {}
    for path, text in files.items():
        prose = re.sub("`[^`]*`", " ", re.sub(r"```+.*?(?:```+|\Z)|~~~+.*?(?:~~~+|\Z)", "\n", text or "", flags=re.S))
        own = []
        for r in re.findall(r"(?:^|[\s(])@([^\s()`]+)", prose):
            r = r.rstrip(".,;:")
            if r and r not in own:
                own.append(r)
        refs[path] = own
    seen, frontier, out = {*seeds, *known}, sorted(set(seeds)), {}
    for depth in range(1, 6):
        new = {}
        for src in frontier:
            for r in refs.get(src, []):
                way = home + r[1:] if r.startswith("~/") else r if r.startswith("/") else posixpath.join(posixpath.dirname(src), r)
                dst = posixpath.normpath(way)
                if dst in files and dst not in seen and dst not in new:
                    severity = severity_of(dst)
                    state = "too deep" if depth > 4 else "credential" if severity else "reached" if dst.startswith(home + "/") else "outside"
                    new[dst] = (depth, src, r, state, severity if state == "credential" else None)
        seen |= set(new)
        out |= new
        frontier = sorted(p for p, v in new.items() if v[3] == "reached")
    return out


def severity_of(path: str) -> str | None:
    parts, name = path.split("/"), path.rsplit("/", 1)[-1].lower()
    if set(parts) & set(paths.SENSITIVE):
        return "medium" if ".config" in parts else "high"
    if name.endswith((".example", ".sample", ".template", ".dist")):
        return None
    return "high" if name in (".env", "id_rsa") or name.startswith(".env.") or name.endswith(".key") else "medium" if name.endswith(".pem") else None


def frames(spark, roots: dict):
    files = [(r, home, p, t) for r, (home, texts, *_) in roots.items() for p, t in texts.items()]
    seeds = [(r, p) for r, (_, _, s, _) in roots.items() for p in s]
    known = [(r, p) for r, (*_, k) in roots.items() for p in k]
    two = "root int, path string"
    return spark.createDataFrame(files, "root int, home string, path string, text string"), spark.createDataFrame(seeds, two), spark.createDataFrame(known, two)


def expanded(spark, roots: dict) -> dict:
    out = {r: {} for r in roots}
    for r in imports.expand(*frames(spark, roots)).collect():
        assert r.path not in out[r.root]
        out[r.root][r.path] = (r.depth, r.importer, r.ref, r.state, r.severity)
    return out


def test_against_search(spark):
    rng, roots = random.Random(4), {}
    for root in range(6):
        home = f"/home/u{root}"
        names = [f"{home}/p/f{k}.md" for k in range(14)] + [f"{home}/.env", f"{home}/.ssh/x", f"{home}/.config/y", f"{home}/a.pem", f"{home}/.env.sample", "/etc/z.md", "/a.md"]
        spell = lambda p: rng.choice([p, posixpath.relpath(p, f"{home}/p"), "./" + posixpath.relpath(p, f"{home}/p"), "x/../" + posixpath.relpath(p, f"{home}/p"), "~" + p[len(home) :] if p.startswith(home) else p])  # noqa: B023, E731
        texts = {}
        for p in names:
            parts = [rng.choice(["@{}", "(@{})", "see @{},", "`@{}`", "a@{}", "@{}.", "```\n@{}\n```", "@gone/{}"]).format(spell(rng.choice(names))) for _ in range(rng.randrange(4))]
            texts[p] = rng.choice([" ", "\n"]).join(parts) or None
        roots[root] = (home, texts, rng.sample(names[:14], 2), names[13:14])
    assert expanded(spark, roots) == {r: search(t, s, k, h) for r, (h, t, s, k) in roots.items()}


def test_cycles_chains_and_refusals(spark):
    home = "/h/u"
    chain = {f"{home}/c{k}.md": f"@c{k + 1}.md" for k in range(7)}
    cycle = {f"{home}/a.md": "@b.md @a.md", f"{home}/b.md": "@a.md @gone.md", f"{home}/self.md": "@./self.md"}
    secret = {f"{home}/s.md": "@~/.ssh/key and @../../../etc/x @up/../t.md", f"{home}/.ssh/key": "@a.md", "/etc/x": "@/h/u/a.md", f"{home}/t.md": "@../u/c0.md"}
    roots = {
        1: (home, chain, [f"{home}/c0.md"], []),
        2: (home, cycle, [f"{home}/a.md", f"{home}/self.md"], []),
        3: (home, {**secret, **chain}, [f"{home}/s.md"], [f"{home}/c0.md"]),
    }
    got = expanded(spark, roots)
    assert [(p[-5:], v[0], v[3]) for p, v in sorted(got[1].items())] == [(f"c{k}.md", k, "reached") for k in range(1, 5)] + [("c5.md", 5, "too deep")]
    assert list(got[2]) == [f"{home}/b.md"]
    assert got[3] == {f"{home}/.ssh/key": (1, f"{home}/s.md", "~/.ssh/key", "credential", "high"), "/etc/x": (1, f"{home}/s.md", "../../../etc/x", "outside", None), f"{home}/t.md": (1, f"{home}/s.md", "up/../t.md", "reached", None)}
    found = imports.findings(imports.expand(*frames(spark, roots))).collect()
    assert sorted((r.root, r.rule, r.severity, r.snippet) for r in found) == [
        (1, "COV-000", "low", "@c5.md"),
        (3, "COV-000", "high", "@~/.ssh/key"),
        (3, "COV-000", "medium", "@../../../etc/x"),
        (3, "EXFIL-005", "high", "@~/.ssh/key"),
    ]


def test_nothing(spark):
    assert expanded(spark, {1: ("/h", {"/h/a.md": None}, ["/h/a.md"], [])}) == {1: {}}
    empty = [spark.createDataFrame([], s) for s in ("root int, home string, path string, text string", "root int, path string", "root int, path string")]
    assert imports.expand(*empty).count() == 0
