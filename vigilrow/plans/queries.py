"""Queries of the engine over the test tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.functions import scalar
from vigilrow.operators import comments, digests, evaluation, hygiene, judge, layout, permissions, rules, score, structural, suppress
from vigilrow.plans.tables import UNITS_SQL, fences_sql, quoted, read, spread, units
from vigilrow.sources import readers
from vigilrow.streaming import gate

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_RULES_SQL = "rules as (select * from (values " + ", ".join(f"({quoted(role)}, {quoted(r.id)}, {r.dimension}, {quoted(r.severity)}, {quoted(r.pattern)}, {quoted(r.veto)}, {str(r.raw_only).lower()}, {str(r.advisory).lower()})" for role, i in rules.gates() for r in [next(r for r in rules.RULES if r.id == i)]) + ") t(role, rule, dimension, severity, pattern, veto, raw_only, advisory))"

#: What a language's text is without comments: strings stay, comments go but for their line ends.
_VIEW_SQL = "case " + " ".join(
    f"when lang = '{k}' and ({' or '.join(f'contains(text, {quoted(o)})' for o in comments.OPENERS[k])}) then (select string_agg(string_split(x, chr(57344))[1] || regexp_replace(coalesce(string_split(x, chr(57344))[2], ''), '[^\\n]+', '', 'g'), '' order by i) "
    f"from (select unnest(m) as x, unnest(range(len(m))) as i from (select string_split(regexp_replace(text, {quoted(comments.re2(comments.PARTS[k]))}, '\\1' || chr(57344) || '\\2' || chr(57345), 'g'), chr(57345)) as m)))"
    for k in ("hash", "c")
) + " end"
_ENDING_SQL = " ".join(f"when lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) in ({', '.join(map(quoted, v))}) then '{k}'" for k, v in (("hash", comments.HASH), ("c", comments.C_STYLE), ("md", ("md",))))
_CUES_SQL = quoted("(?i)" + layout.CUES)


def example_sql(pattern: str, seen: str) -> str:
    """Whether what the pattern finds first stands in quotes and the line has a cue."""
    p = pattern.removeprefix("(?i)")
    before, behind = (f"regexp_extract({seen}, {quoted(f'(?i)^{x}')}, 1)" for x in (f"([^\\n]*?)(?:{p})", f"[^\\n]*?(?:{p})([^\\n]*)"))
    return f"(regexp_matches({seen}, {_CUES_SQL}) and (" + " or ".join(f"(contains({before}, {quoted(a)}) and contains({behind}, {quoted(b)}))" for a, b in layout.QUOTES) + "))"


#: Logical lines, their normalised view and what rules find in them.
_LINES_SQL = (
    UNITS_SQL
    + f""",
known as (select *, case {_ENDING_SQL} end as lang, row_number() over () as u from units),
viewed as (select *, string_split(text, chr(10)) as parts, string_split({_VIEW_SQL}, chr(10)) as code, case when lang = 'md' and contains(text, '\\' || chr(10)) then {fences_sql(True)} end as fences from known),
physical as (select artifact, unit, role, file, lang, u, k, parts[k] as part, code is not null and translate(code[k], ' ' || chr(9) || chr(13), '') = '' and translate(parts[k], ' ' || chr(9) || chr(13), '') <> '' as comment, coalesce(fences[k], false) as fenced from (select *, unnest(range(1, len(parts) + 1)) as k from viewed)),
ended as (select *, k < count(*) over (partition by u) and regexp_matches(part, '(^|[^\\\\])(?:\\\\\\\\)*\\\\$') and ((role = 'hook' or coalesce(lang, '') = 'hash') and not comment or fenced) as goes_on from physical),
begun as (select *, coalesce(lag(goes_on) over (partition by u order by k), false) as goes from ended),
numbered as (select *, sum(case when goes then 0 else 1 end) over (partition by u order by k) as n from begun),
lines as (select any_value(artifact) as artifact, any_value(unit) as unit, any_value(role) as role, any_value(file) as file, min(k) as line, arg_min(comment, k) as comment, string_agg(case when goes_on then left(part, length(part) - 1) else part end, '' order by k) as raw from numbered group by u, n),
views as (select *, regexp_replace(regexp_replace(translate(regexp_replace(raw, '[{scalar.INVISIBLE}]', '', 'g'), '{scalar.LOOKALIKE[0]}', '{scalar.LOOKALIKE[1]}'), '([A-Za-z0-9_])(?:''''|"")\\b', '\\1', 'g'), '([A-Za-z0-9_])\\\\\\b', '\\1', 'g') as norm from lines),
{_RULES_SQL},
hits as (select artifact, unit, role, file, line, rule, dimension, severity, raw, norm, case when raw_hit then 'raw' else 'norm' end as view from (
  select v.*, r.rule, r.dimension, r.severity, regexp_matches(raw, pattern) and not (veto <> '' and regexp_matches(raw, veto)) as raw_hit,
    not raw_only and norm <> raw and regexp_matches(norm, pattern) and not (veto <> '' and regexp_matches(norm, veto)) as norm_hit
  from views v join rules r using (role)) where (raw_hit or norm_hit) and not (comment and dimension not in (0, 6))),
findings as (select artifact, unit, file, line, rule, dimension, severity, view from hits where role = 'script' or not case rule {" ".join(f"when '{r.id}' then " + example_sql(r.pattern, "(case view when 'raw' then raw else norm end)") for r in rules.RULES if r.id in rules.PHRASES)} else false end)"""
)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.evaluate(rules.lines(units(spark, sf_dir)))
    return found.select("artifact", "unit", "file", "line", "rule", "dimension", "severity", "view").withColumn("source", F.lit("static")).withColumn("escalates", F.lit(False))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("artifact")).distinct()


_PENALTY_SQL = "case severity when 'critical' then 40 when 'high' then 25 when 'medium' then 12 when 'low' then 5 else 0 end"
_RANK_SQL = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_SCORES_SQL = f"""scores as (select artifact, greatest(0, least(100, 100 - coalesce(p, 0)))::bigint as score from (select distinct source as artifact from documents) left join
  (select artifact, sum(p) as p from (select artifact, dimension, max({_PENALTY_SQL}) as p from findings group by all) group by artifact) using (artifact))"""


@query(f"with {_LINES_SQL} select unit, line::bigint as line, rule, view from findings")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("unit", F.col("line").cast("long").alias("line"), "rule", "view")


@query(f"with {_LINES_SQL}, {_SCORES_SQL} select artifact, score, score as effective_score, case when score >= 85 then 'Low' when score >= 70 then 'Watch' when score >= 50 then 'Elevated' else 'High' end as band from scores")
def artifact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.artifact_scores(_artifacts(spark, sf_dir), _findings(spark, sf_dir))


@query(f"""with {_LINES_SQL}, {_SCORES_SQL}, w as (select coalesce(max({_RANK_SQL}), 0) as worst from findings where dimension <> 0)
select count(*) as units, floor(avg(score))::bigint as mean, case (select worst from w) when 4 then 49 when 3 then 69 else 100 end::bigint as ceiling,
  least(floor(avg(score)), case (select worst from w) when 4 then 49 when 3 then 69 else 100 end)::bigint as score from scores""")
def environment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.environment_score(_artifacts(spark, sf_dir), _findings(spark, sf_dir))


@query(f"""with {_LINES_SQL}, n as (select *, row_number() over (partition by artifact, rule order by file, line) as n from findings)
select artifact, rule, count(*) as n_findings, count(distinct file) as n_files, max({_RANK_SQL})::bigint as severity_rank,
  string_agg(case when n <= 3 then file || ':' || line end, ',' order by file, line) as places from n group by artifact, rule""")
def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.report(_findings(spark, sf_dir))


@query(f"""with {_LINES_SQL}, n as (select *, row_number() over (partition by artifact order by {_RANK_SQL} desc, rule, file, line) as place, greatest(count(*) over (partition by artifact) - 5, 0) as omitted from findings)
select artifact, place::bigint as place, rule, file, line::bigint as line, omitted::bigint as omitted from n where place <= 5""")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.top(_findings(spark, sf_dir), 5)
    return found.select("artifact", F.col("place").cast("long").alias("place"), "rule", "file", F.col("line").cast("long").alias("line"), F.col("omitted").cast("long").alias("omitted"))


@query(f"with {_LINES_SQL} select artifact, bool_or({_RANK_SQL} >= 3 and dimension <> 0) as static_fail, bool_or({_RANK_SQL} >= 3 and dimension <> 0) as effective_fail from findings group by artifact")
def fail_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.fails(_findings(spark, sf_dir), "high")


@query(f"""with {_LINES_SQL}, s as (select *, (rule = 'SUP-003') or regexp_matches(file, '^f1[^/]*$') and rule = 'FS-001' or regexp_matches(file, '^[^/]*7\\.txt$') as suppressed from findings)
select count(*) filter (suppressed) as n_suppressed, coalesce(max({_RANK_SQL}) filter (suppressed), 0)::bigint as highest from s""")
def suppression_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.tally(suppress.suppress(_findings(spark, sf_dir), [("SUP-003", ""), ("FS-001", "f1*"), ("*", "*7.txt")]))


@query("""with a as (select doc_id as artifact, case when doc_id % 4 <> 0 then doc_id - doc_id % 4 end as parent, case when doc_id % 11 = 0 then '' else sha256(text) end as hash from documents),
k as (select sha256(text) as hash, 'BAD' as verdict from benchmark union all select sha256(text), 'GOOD' from documents where doc_id % 8 = 0),
v as (select hash, min(verdict) as own from k where hash <> '' group by hash),
o as (select a.*, own from a left join v using (hash))
select artifact, coalesce(own, (select 'GOOD' from o p where p.artifact = o.parent and p.own = 'GOOD' limit 1)) as verdict from o""")
def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    own = d.select(F.col("doc_id").alias("artifact"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - F.col("doc_id") % 4).alias("parent"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.sha2("text", 256)).alias("hash"))
    known = read(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("hash"), F.lit("BAD").alias("verdict")).union(d.filter("doc_id % 8 = 0").select(F.sha2("text", 256), F.lit("GOOD")))
    return suppress.reputation(own, known).select("artifact", "verdict")


_PHYSICAL_SQL = UNITS_SQL + ", lines as (select artifact, unit, role, file, k as line, parts[k] as raw from (select *, unnest(range(1, len(parts) + 1)) as k from (select *, string_split(text, chr(10)) as parts from units)))"
_SIGHTINGS_SQL = _PHYSICAL_SQL + f""", sightings as (select unit, artifact, line, 'credential' as leg from lines where regexp_matches(raw, {quoted(structural.CREDENTIAL)})
  union all select unit, artifact, line, 'network' from lines where regexp_matches(raw, {quoted(structural.NETWORK)})
  union all select unit, artifact, line, 'encode' from lines where regexp_matches(raw, {quoted(structural.ENCODE)}))"""
_LEGS_SQL = _SIGHTINGS_SQL + """,
legs as (select * from (select *, row_number() over (partition by unit, leg order by line) as n from sightings) where n <= 64)"""


def _physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.physical_lines(units(spark, sf_dir))


@query(f"""with {_SIGHTINGS_SQL}, p as (select c.unit, c.line as c, n.line as n, row_number() over (partition by c.unit order by abs(c.line - n.line), c.line, n.line) as k from sightings c join sightings n on c.unit = n.unit and c.leg = 'credential' and n.leg = 'network')
select unit, c::bigint as credential_line, n::bigint as network_line, unit in (select unit from sightings where leg = 'encode') as encodes, case when unit in (select unit from sightings where leg = 'encode') then 'EXFIL-003' else 'EXFIL-001' end as rule from p where k = 1""")
def closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structural.closest_pairs(structural.legs(_physical(spark, sf_dir)))
    return found.select("unit", F.col("credential_line").cast("long").alias("credential_line"), F.col("network_line").cast("long").alias("network_line"), "encodes", "rule")


@query(f"""with {_LEGS_SQL}, a as (select unit // 4 as g, unit, bool_or(leg = 'credential') as c, bool_or(leg = 'network') as n from legs group by all)
select g::bigint as artifact from a group by g having bool_or(c) and bool_or(n) and not bool_or(c and n)""")
def cross_file_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = structural.legs(_physical(spark, sf_dir)).withColumn("artifact", F.floor(F.col("unit") / 4))
    return structural.cross_file_chains(legs)


@query("""with u as (select doc_id as unit, text || repeat(chr(10), (150 + doc_id % 100)::int) || 'end' as text from documents where text is not null),
l as (select unit, k, trim(parts[k]) = '' as blank, k < len(parts) as more from (select *, unnest(range(1, len(parts) + 1)) as k from (select unit, string_split(text, chr(10)) as parts from u))),
i as (select *, k - row_number() over (partition by unit order by k) as island from l where blank),
r as (select unit, island, count(*) as length, max(k) + 1 as next, bool_or(not more) as open from i group by all having count(*) >= 200)
select unit, length, next as content_line from (select *, row_number() over (partition by unit order by length desc, next) as n from r where not open) where n = 1""")
def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("text is not null")
    padded = d.select(F.col("source").alias("artifact"), F.col("doc_id").alias("unit"), F.lit("script").alias("role"), F.lit("f").alias("file"), F.concat("text", F.expr("repeat('\n', cast(150 + doc_id % 100 as int))"), F.lit("end")).alias("text"))
    found = structural.blank_runs(structural.physical_lines(padded))
    return found.select("unit", "length", F.col("content_line").cast("long").alias("content_line"))


@query(f"""with {_PHYSICAL_SQL}, w as (select unit, line, regexp_extract(raw, '>[\\t\\n\\f\\r ]*(/tmp/[A-Za-z0-9._/-]+)', 1) as path from lines),
s as (select unit, line, regexp_extract(raw, '(?:source|\\.)[\\t\\n\\f\\r ]+(/tmp/[A-Za-z0-9._/-]+)', 1) as path from lines where regexp_matches(raw, '>>[\\t\\n\\f\\r ]*~/\\.(?:bashrc|zshrc|profile)'))
select w.unit, w.path, min(w.line)::bigint as written, min(s.line)::bigint as sourced from w join s using (unit, path) where w.path <> '' and w.line <> s.line group by all""")
def written_then_sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.written_then_sourced(_physical(spark, sf_dir))


@query(f"""with {_PHYSICAL_SQL}, t as (select unit, line, regexp_extract(raw, 'registry[\\t\\n\\f\\r ]+([^\\t\\n\\f\\r ]+)', 1) as target from lines),
a as (select unit, line, regexp_extract(raw, '^([A-Z_]+)=([^\\t\\n\\f\\r ]+)', 1) as name, regexp_extract(raw, '^([A-Z_]+)=([^\\t\\n\\f\\r ]+)', 2) as value from lines where regexp_matches(raw, '^[A-Z_]+=[^\\t\\n\\f\\r ]')),
u as (select unit, line, target, regexp_extract(target, '^\\$\\{{?([A-Z_]+)', 1) as name from t where target <> ''),
h as (select u.unit, u.line, lower(regexp_extract(case when u.name = '' then any_value(target) else arg_max(value, a.line) end, '(?i)^https?://([A-Za-z0-9.-]+)', 1)) as host from u left join a on a.unit = u.unit and a.name = u.name and a.line <= u.line group by u.unit, u.line, u.name)
select unit, line::bigint as line, host from h where host <> '' and host not in ('registry.npmjs.org', 'pypi.org')""")
def registry_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.registry_redirects(_physical(spark, sf_dir))


@query("""with t as (select item_id as item, list_sort(list_distinct(regexp_extract_all(lower(text || ' ' || regexp_replace(text, '^[^ ]+', '')), '[a-z0-9]{3,}'))) as t, text from benchmark)
select item, ceil(length(trim(text)) / 4.0)::bigint as tokens, len(t)::bigint as n_words from t""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("item"), scalar.estimate_tokens("text").alias("tokens"), F.size(scalar.tokens("text")).cast("long").alias("n_words"))


@query("""select doc_id as item, ceil(length(trim(text)) / 4.0)::bigint as tokens, ceil(length(trim(text)) / 4.0)::bigint - 200 as reclaim from documents where ceil(length(trim(text)) / 4.0) > 200""")
def context_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.context_bloat(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("description")))


@query("""with s as (select doc_id as item, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) as t from documents),
e as (select item, unnest(t) as w from s), n as (select item, len(t) as n from s),
p as (select x.item as a, y.item as b, count(*) as shared from e x join e y on x.w = y.w and x.item < y.item group by all)
select a, b, shared, na.n + nb.n - shared as n_all from p join n na on na.item = a join n nb on nb.item = b where shared >= (na.n + nb.n - shared) * 0.6""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.duplicate_pairs(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("description")))


@query("""with r as (select page_id as item, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) as target from pages),
f as (select distinct unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as path from pages where page_id % 3 = 0)
select item, count(*) as n_missing, string_agg(target, ',' order by target) as targets from r where target not in (select path from f) group by item""")
def stale_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    return hygiene.stale_references(links.select(F.col("page_id").alias("item"), "target"), links.filter("page_id % 3 = 0").select(F.col("target").alias("path")))


@query("select c_custkey as item from customer where c_custkey not in (select user_id from events where event_type = 'purchase')")
def unused_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = read(spark, sf_dir, "events").select(F.col("user_id").alias("item"), (F.col("event_type") == "purchase").alias("strict"))
    return hygiene.unused(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), usage)


GRANTS = ("Bash(*)", "Bash(python *)", "Bash(git status)", "Bash(git -c *)", "Bash(find . -exec *)", "Bash(find . -name *)", "Read(**)", "Bash(API_KEY=abcdef123456 run)", "Bash(sudo *)", "Edit(src/main.py)", "Bash(ls *)", "Bash(docker run *)")

#: What each grant is by itself, in order: worked out by hand.
_GRANT_RULES = ("PERM-005", "PERM-002", "", "PERM-006", "PERM-006", "", "PERM-003", "PERM-001", "PERM-006", "", "", "PERM-006")


@query(f"""with s as (select p_partkey as item, [{', '.join(map(quoted, GRANTS))}][(p_partkey % 12) + 1] as grant_, [{', '.join(map(quoted, _GRANT_RULES))}][(p_partkey % 12) + 1] as rule, p_size % 2 = 0 as denied from part),
r as (select item, grant_ as grant, rule from s where rule <> '' union all select item, '', 'PERM-004' from s where not denied)
select item, "grant", rule, case rule when 'PERM-001' then 3 when 'PERM-003' then 9 else 2 end as dimension, case rule when 'PERM-001' then 'high' when 'PERM-005' then 'high' when 'PERM-003' then 'low' when 'PERM-004' then 'low' else 'medium' end as severity from r""")
def permission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    grant = F.element_at(F.array(*map(F.lit, GRANTS)), (F.col("p_partkey") % 12).cast("int") + 1)
    deny = F.when(F.col("p_size") % 2 == 0, F.lit('["Read(.env)"]')).otherwise("[]")
    text = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat(F.lit('{"permissions": {"allow": ["'), grant, F.lit('"], "deny": '), deny, F.lit("}}")).alias("json"))
    return permissions.audit(readers.settings(text)[0])


@query("""with h as (select s_suppkey as item, case when s_suppkey % 3 = 0 then 'PreToolUse' else 'SessionStart' end as event from supplier)
select item, event, 'Bash' as matcher, 'command' as type, 'run-' || item || '.sh' as command, null::varchar as url from h union all select item, event, 'Bash', 'http', null, 'http://127.0.0.1:' || item from h""")
def hook_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("s_suppkey") % 3 == 0, "PreToolUse").otherwise("SessionStart")
    text = F.format_string('{"hooks": {"%s": [{"matcher": "Bash", "hooks": [{"type": "command", "command": "run-%s.sh"}, {"type": "http", "url": "http://127.0.0.1:%s"}]}]}}', event, F.col("s_suppkey"), F.col("s_suppkey"))
    return readers.settings(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), text.alias("json")))[2]


@query("""select n_nationkey::bigint as item, 'srv' || n_nationkey as name, 'node ' || n_name || '.js' as command, 'A=1' || chr(10) || 'B=' || n_regionkey as env, null::varchar as url from nation""")
def mcp_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    text = F.format_string('{"mcpServers": {"srv%s": {"command": "node", "args": ["%s.js"], "env": {"B": "%s", "A": "1"}}}}', "k", "n_name", F.col("n_regionkey").cast("long"))
    return readers.servers(n.select(F.col("k").alias("item"), text.alias("json")))


@query("""with s as (select event_id, 'c' || (user_id % 20) as name, (user_id * 7 + event_id) % 50 as t from events), b as (select name, max(t) as t from s group by name)
select name, 'tool' as tool, name || '/tool: v' || min(event_id) as text from s join b using (name, t) group by name""")
def connector_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("name", F.concat(F.lit("c"), F.col("user_id") % 20)).withColumn("at", (F.col("user_id") * 7 + F.col("event_id")) % 50)
    text = F.format_string('{"lastActivityAt": %s, "remoteMcpServersConfig": [{"name": "%s", "uuid": "u", "tools": [{"name": "tool", "description": "v%s"}]}]}', "at", "name", "event_id")
    return readers.connectors(e.select(F.format_string("%012d", "event_id").alias("file"), text.alias("json")))


@query("""with p as (select doc_id, x, count(*)::double as k from (select doc_id, unnest(string_split(text, '')) as x from documents where text <> '') group by all)
select doc_id, round(-sum(k / n * log2(k / n)), 6) as bits from (select doc_id, k, sum(k) over (partition by doc_id) as n from p) group by doc_id""")
def document_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.entropies(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(text, '[^\\t\\n\\f\\r ]+')) as token from documents),
p as (select doc_id, token, x, count(*)::double as k from (select doc_id, token, unnest(string_split(token, '')) as x from (select distinct doc_id, token from t)) group by all),
e as (select doc_id, token, round(-sum(k / n * log2(k / n)), 6) as bits from (select *, sum(k) over (partition by doc_id, token) as n from p) group by all)
select doc_id, count(*) as n_tokens, max(bits) as bits from e group by doc_id""")
def character_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of each whole text and the highest entropy of one of them."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    tokens = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), F.lit(0)))).alias("token"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max(F.round(scalar.entropy("token"), 6)).alias("bits"))


@query("""select page_id, len(h)::bigint as n_hosts, array_to_string(h, ',') as hosts, len(h) > 0 and len(list_filter(h, lambda x: not regexp_matches(x, '^(?:localhost|127(?:\\.[0-9]{1,3}){3}|::1)$'))) = 0 as loopback
from (select page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html || case page_id % 4 when 0 then ' http://localhost:80/a' when 1 then ' https://u:p@Example.COM/x' when 2 then ' http://[::1]/y' else '' end, '(?i)\\bhttps?://(?:[^/\\s@]*@)?(\\[[0-9a-f:]+\\]|[A-Za-z0-9.-]+)', 1), lambda x: lower(translate(x, '[]', ''))))) as h from pages)""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(*map(F.lit, (" http://localhost:80/a", " https://u:p@Example.COM/x", " http://[::1]/y", ""))), (F.col("page_id") % 4).cast("int") + 1)
    p = read(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("html")).select("page_id", scalar.hosts("html").alias("h"))
    return p.select("page_id", F.size("h").cast("long").alias("n_hosts"), F.array_join("h", ",").alias("hosts"), scalar.all_loopback("h").alias("loopback"))


#: Lines with secrets, added to documents by doc_id.
SECRETS = ("login --password=s3cr3tvalue now", "https://bob:pw1234@example.com/x", 'api_key: "abcd1234efgh"', "use ghp_abcdefghijklmnop0123", "token = true", "curl -u me:hidden x", "x Zk3vQ9tLr7WmXc2Nb8Yp4HdJ y")


@query()
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts and a line with a secret behind each. Without SQL: tests/test_whole_texts.py holds it against brute force."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    more = F.element_at(F.array(*map(F.lit, SECRETS)), F.pmod("doc_id", F.lit(len(SECRETS))).cast("int") + 1)
    return d.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more)).select("doc_id", scalar.redact("text").alias("redacted"))


@query()
def document_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL: tests/test_whole_texts.py holds it against brute force."""
    return read(spark, sf_dir, "documents").withColumn("text", scalar.redact("text"))


@query("""select artifact, sha256(unhex(string_agg(hex(encode(path)) || '00' || sha, '' order by path))) as hash from (select source as artifact, 'f' || lpad(doc_id::varchar, 9, '0') as path, sha256(text) as sha from documents where text is not null) group by artifact""")
def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("text is not null")
    return digests.tree_hash(d.select(F.col("source").alias("artifact"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.sha2("text", 256).alias("sha256")))


@query("""with j as (select user_id as journal, event_id as line_no, event_type || value::decimal(18, 2)::varchar as raw from events),
l as (select *, coalesce(lag(sha256(raw)) over (partition by journal order by line_no), 'genesis') as want from j),
p as (select *, case when line_no % 89 = 31 then null when line_no % 50 = 7 then '' when line_no % 97 = 13 then 'forged' else want end as prev from l),
f as (select journal, min(line_no) filter (prev is null or prev <> '' and prev <> want) as first from p group by journal)
select journal, count(*) as n_lines, count(*) filter (prev = '' and (first is null or line_no < first)) as unchained, first as first_break, coalesce(bool_or(line_no = first and prev is null), false) as corrupt from p join f using (journal) group by journal, first""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("journal"), F.col("event_id").alias("line_no"), F.concat("event_type", F.col("value").cast("decimal(18,2)").cast("string")).alias("raw"))
    want = F.coalesce(F.lag(F.sha2("raw", 256)).over(Window.partitionBy("journal").orderBy("line_no")), F.lit("genesis"))
    prev = F.when(F.col("line_no") % 89 != 31, F.when(F.col("line_no") % 50 == 7, "").when(F.col("line_no") % 97 == 13, "forged").otherwise(want))
    return digests.chain_breaks(e.withColumn("prev", prev))


@query("""with j as (select o_orderkey as place, (o_orderkey * 7) % 50 as batch, o_custkey as item, ['intended', 'done', 'undone', 'intended', 'failed'][(o_orderkey % 5) + 1] as state from orders),
p as (select batch, item, bool_or(state = 'intended') as i, bool_or(state = 'done') as d, bool_or(state = 'failed') as f, bool_or(state = 'undone') as u, min(place) filter (state = 'done') as place from j group by all),
o as (select batch, min(place) as place from p where d and not u group by batch)
select 'pending' as kind, batch, item from p where i and not (d or f or u) union all select 'restorable', batch, item from p where d and not u and batch = (select arg_max(batch, place) from o)""")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("intended", "done", "undone", "intended", "failed"))), (F.col("o_orderkey") % 5).cast("int") + 1)
    pending, restorable = digests.journal_state(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), (F.col("o_orderkey") * 7 % 50).alias("batch"), F.col("o_custkey").alias("item"), state.alias("state")))
    return pending.select(F.lit("pending").alias("kind"), "batch", "item").union(restorable.select(F.lit("restorable"), "batch", "item"))


KINDS = ("skill", "hook", "connector", "server", "mcp", "instruction", "other")


@query(f"""with a as (select doc_id as ordinal, source as artifact, [{', '.join(map(quoted, KINDS))}][(doc_id % 7) + 1] as kind from documents),
p as (select * from (values ('skill', 0, 'LLM-001'), ('skill', 1, 'LLM-003'), ('skill', 2, 'LLM-011'), ('hook', 0, 'LLM-003'), ('hook', 1, 'LLM-008'), ('connector', 0, 'LLM-003'), ('server', 0, 'LLM-010'), ('mcp', 0, 'LLM-009'), ('instruction', 0, 'LLM-003')) t(kind, k, pass)),
c as (select ordinal, artifact, pass, k, s::int as sample from a join p using (kind), (values (1), (2), (3)) v(s))
select ordinal, artifact, pass, sample, row_number() over (order by ordinal, k, sample) <= 500 as sent from c""")
def judge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 7).cast("int") + 1)
    return judge.plan(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("artifact"), kind.alias("kind")), 3, 500)


#: Votes made up from order lines: an item is an order, a sample a line of it.
_VOTES_SQL = """votes as (select l_orderkey as item, l_linenumber as sample, l_returnflag <> 'R' as answered, l_quantity > 25 as flagged, ['low', 'medium', 'high', 'critical'][(l_partkey % 4) + 1] as severity, 'c' || (l_suppkey % 2) as category, 'v' || l_linenumber as text, l_discount > 0.05 as grounded,
  row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as twin from lineitem qualify twin = 1)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = line.withColumn("twin", F.row_number().over(w)).filter("twin = 1")
    severity = F.element_at(F.array(*map(F.lit, scalar.SEVERITIES)), (F.col("l_partkey") % 4).cast("int") + 1)
    return line.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("sample"), (F.col("l_returnflag") != "R").alias("answered"), (F.col("l_quantity") > 25).alias("flagged"), severity.alias("severity"), F.concat(F.lit("c"), F.col("l_suppkey") % 2).alias("category"), F.concat(F.lit("v"), "l_linenumber").alias("text"), (F.col("l_discount") > 0.05).alias("grounded"))


@query(f"""with {_VOTES_SQL}, c as (select *, {_RANK_SQL} as r from votes where answered and flagged), p as (select item, category, count(*) as c, min(r) as r from c group by all),
m as (select *, row_number() over (partition by item order by c desc, r, category desc) as k from p), l as (select item, min(r) as lowest, arg_min(text, sample) as text from c group by item),
b as (select item, count(*) filter (answered) as n, count(*) filter (answered and flagged) as k from votes group by item)
select item, n, b.k as k, n > 0 and b.k >= floor(n / 2.0) + 1 as escalates, (case when m.c * 2 > b.k then m.r else lowest end)::bigint as severity_rank, text from b left join (select * from m where k = 1) m using (item) left join l using (item)""")
def vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.consensus(_votes(spark, sf_dir))


@query(f"with {_VOTES_SQL} select item, count(*) as asked, count(*) filter (answered) as answered, count(*) filter (answered and flagged) as flagged, count(*) filter (answered and not grounded) as ungrounded from votes group by item")
def vote_ballot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.ballot(_votes(spark, sf_dir))


@query("""select event_type as pass, count(*) as calls, count(*) filter (event_id % 17 = 0) as failed, case when bool_or(event_type = 'error') then null else sum(event_id % 3) end::bigint as retries, coalesce(sum(case when event_id % 10 <> 0 then user_id end), 0)::bigint as tokens, count(*) filter (event_id % 10 = 0) as without_tokens from events group by event_type""")
def judge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("pass"), F.when(F.col("event_id") % 17 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("event_type") != "error", F.col("event_id") % 3).alias("retries"), F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("tokens"))
    return judge.statistics(calls)


_OUTCOMES = ("scored", "no-verdict", "error")


@query("""with l as (select doc_id as sample, ['scored', 'no-verdict', 'error'][(doc_id % 3) + 1] as outcome from labels)
select count(*) filter (outcome = 'scored') as scored, count(*) filter (outcome = 'no-verdict') as no_verdict, count(*) filter (outcome = 'error') as errors, (select count(*) from documents)::bigint as listed, count(*) = (select count(*) from documents) as complete from l""")
def outcome_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, _OUTCOMES)), (F.col("doc_id") % 3).cast("int") + 1)
    return evaluation.partition(read(spark, sf_dir, "labels").select(outcome.alias("outcome")), read(spark, sf_dir, "documents"))


@query("""with l as (select doc_id as sample from labels union all select doc_id from labels where doc_id % 13 = 0 union all select -doc_id from labels where doc_id % 29 = 1), r as (select sample, count(*) as n from l group by sample)
select coalesce(r.sample, w.sample) as sample, case when n is null then 'missing' when w.sample is null then 'unlisted' else 'repeated' end as problem from r full join (select distinct doc_id as sample from documents) w on r.sample = w.sample where n is null or w.sample is null or n > 1""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample"))
    ledger = own.union(own.filter("sample % 13 = 0")).union(own.filter("sample % 29 = 1").select(-F.col("sample")))
    return evaluation.reconcile(ledger, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample")))


@query("""with e as (select doc_id, unnest([lang, source]) as surface from documents), h as (select distinct doc_id from labels where toxic = 1), s as (select surface, count(*) as n, count(*) filter (h.doc_id is not null) as flagged from e left join h using (doc_id) group by surface)
select surface, n, flagged, case when n < 22 then 'too few' when flagged = 0 then 'silent' else 'ok' end as status from s""")
def surface_tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), F.array("lang", "source").alias("surface"))
    return evaluation.surfaces(samples, read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("sample")))


_SAMPLES_SQL = "s as (select distinct doc_id as sample, lang as kind, toxic = 1 as malicious from labels join documents using (doc_id)), v as (select distinct sample, rule from (select unit as sample, rule from findings))"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("sample"), F.col("lang").alias("kind"), (F.col("toxic") == 1).alias("malicious")).distinct()


@query(f"""with {_LINES_SQL}, {_SAMPLES_SQL}, a as (select kind, count(*) filter (malicious) as n_malicious, count(*) filter (not malicious) as n_benign from s group by kind),
h as (select kind, rule, count(*) filter (malicious) as caught, count(*) filter (not malicious) as false_alarms from v join s using (sample) group by all),
j as (select h.*, n_malicious, n_benign, false_alarms::double / n_benign as p, n_benign::double as n, 1.959963984540054 as z from h join a using (kind) where n_benign > 0),
w as (select *, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) as low_, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) as high_ from j)
select kind, rule, caught, false_alarms, n_malicious, n_benign, round(low_, 6) + 0.0 as low, round(high_, 6) + 0.0 as high, false_alarms || ' / ' || n_benign || case when (high_ - low_) / 2 <= 0.15 then ' (' || floor(p * 100 + 0.5)::int || ' %)' else '' end as cell from w""")
def rule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _findings(spark, sf_dir).select(F.col("unit").alias("sample"), "rule")
    found = evaluation.with_interval(evaluation.rates(_samples(spark, sf_dir), votes).filter("n_benign > 0"), "false_alarms", "n_benign")
    return found.select("kind", "rule", "caught", "false_alarms", "n_malicious", "n_benign", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "cell")


@query("""with s as (select distinct doc_id as sample, lang as kind from labels join documents using (doc_id) where toxic = 1)
select kind, count(*) as n, count(*) filter (sample % 3 = 0) as static_caught, count(*) filter (sample % 2 = 0 and sample % 3 <> 0) as votes_only from s group by kind""")
def delta_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    return evaluation.delta_recall(s, s.filter("sample % 3 = 0"), s.filter("sample % 2 = 0"))


@query("""select event_type, list_sort(list(value))[floor((count(*) - 1) * 0.9)::int + 1] as value from events where value is not null group by event_type""")
def nearest_rank_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(read(spark, sf_dir, "events"), "event_type", "value", 0.9)


@query("""select a.event_id as ask_id, c.event_id as confirm_id from events a join events c on a.user_id = c.user_id and a.event_id % 5 = c.event_id % 5 and a.event_type = 'click' and c.event_type = 'purchase' and c.ts between a.ts and a.ts + interval 1 hour""")
def gate_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 5).alias("h"), F.col("ts").alias("at"), "event_type", "event_id")
    asks, confirms = e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'")
    # the hash carries the event's own number behind a part that must be equal
    a = asks.select("id", F.col("h").alias("hash"), "at", F.col("event_id").alias("ask_id"))
    c = confirms.select("id", F.col("h").alias("hash"), "at", F.col("event_id").alias("confirm_id"))
    found = gate.confirmations(a, c)
    keyed = found.join(a.select("id", "hash", F.col("at").alias("asked_at"), "ask_id"), ["id", "hash", "asked_at"]).join(c.select("id", "hash", F.col("at").alias("confirmed_at"), "confirm_id"), ["id", "hash", "confirmed_at"])
    return keyed.select("ask_id", "confirm_id")


@query("""select event_id, case when user_id % 10 = 0 then 'allow' when value < 10 then 'allow' when event_type in ('click', 'view') then 'deny' else 'ask' end as decision from events""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10 == 0).alias("known"), F.when(F.col("value") < 10, 0).otherwise(1).alias("findings"), F.when(F.col("event_type").isin("click", "view"), "auto").otherwise("default").alias("mode"))
    return e.select("event_id", gate.decide("findings", "mode", "known").alias("decision"))
