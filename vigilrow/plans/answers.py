"""Queries of what models reply and of what is shown of arguments and addresses, with the DuckDB SQL of the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.functions import redaction
from vigilrow.operators import grounding, replies
from vigilrow.plans.queries import query
from vigilrow.plans.tables import pick, read, spread

#: Forms of a reply by doc_id; {o} is the object.
_FORMS = (
    "{o}",
    "My answer:\n```json\n{o}\n```\nThat is all.",
    '{o}, "barrier_evidence": "none"}',
    '{o}, "flagged": false}',
    "{o} {o}",
    None,
    '{"flagged": true, "evidence": "it begins with',
    'Read.\n{o}, "barrier_evidence": ""}\n```',
    '{o}, "barrier_evidence": ""} and more',
)
_SEVERITIES = ("low", "Medium", " high", "critical")
_PASSES = ("LLM-001", "LLM-003", "LLM-008")

_REPLIES_SQL = r"""r as (select doc_id as item, ['LLM-001', 'LLM-003', 'LLM-008'][doc_id % 3 + 1] as pass, doc_id % 4 + 1 as sample, doc_id % 2 = 0 as f, coalesce(text, '') as t,
  case when doc_id % 9 = 5 then 'missing' when doc_id % 9 in (0, 1, 2, 7) then 'read' else 'unreadable' end as status from documents),
v as (select *, status = 'read' as answered, f and status = 'read' as flagged, item % 9 in (2, 7) as mended,
  case when status <> 'read' then null when item % 5 = 2 then 'no such passage ' || item else t end as quote from r)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, pass, sample, reply, text: a verdict on each document whose evidence is its whole text."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    evidence = F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("no such passage "), "doc_id")).otherwise(F.coalesce("text", F.lit("")))
    verdict = F.to_json(F.struct((F.col("doc_id") % 2 == 0).alias("flagged"), pick(_SEVERITIES, F.col("doc_id")).alias("severity"), F.lit("c1").alias("category"), evidence.alias("evidence")))
    reply = F.replace(pick(_FORMS, F.col("doc_id")), F.lit("{o}"), verdict)
    return d.select(F.col("doc_id").alias("item"), pick(_PASSES, F.col("doc_id")).alias("pass"), (F.col("doc_id") % 4 + 1).alias("sample"), reply.alias("reply"), "text")


@query(f"""with {_REPLIES_SQL} select item, pass, sample, status, coalesce(mended, false) and status = 'read' as mended, answered, flagged,
  case when answered then ['low', 'medium', 'high', 'critical'][item % 4 + 1] end as severity, sha256(quote) as evidence_sha256 from v""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cast = replies.votes(_replies(spark, sf_dir))
    return cast.select("item", "pass", "sample", "status", F.coalesce("mended", F.lit(False)).alias("mended"), "answered", "flagged", "severity", F.sha2("text", 256).alias("evidence_sha256"))


@query(rf"""with {_REPLIES_SQL}, g as (select *, quote not like 'no such passage %' and regexp_replace(t, '\s', '', 'g') <> '' as grounded from v),
p as (select pass, count(*) as al, count(*) filter (not answered) as lost, count(*) filter (flagged) as flags, count(*) filter (flagged and not grounded) as loose from g group by pass)
select * from (select 'LLM-000' as rule, pass, lost as n, al as "of" from p union all select 'LLM-005', pass, loose, flags from p) where n > 0""")
def reply_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to votes, their quotes to places in the texts judged, and both to notes."""
    made = _replies(spark, sf_dir)
    cast = replies.votes(made)
    quotes = cast.select("item", F.col("item").alias("artifact"), F.col("text").alias("quote"))
    found = grounding.ground(quotes, made.select(F.col("item").alias("artifact"), F.col("item").alias("unit"), "text"))
    return replies.notes(cast.join(found.select("item", "grounded"), "item"))


_SAID = ("likely-benign", "Likely-Benign (an example)", "likely-real", "not likely-benign", "likely-benign, or likely-real", "", "likely-benign")


@query("""with s as (select doc_id // 10 as artifact, 'R-' || (doc_id % 7) as rule, doc_id % 7 in (0, 1, 6) as benign from documents),
f as (select distinct doc_id // 10 as artifact, 'R-' || (length(text) % 7) as rule from documents where text is not null)
select artifact, rule, case when bool_and(benign) then 'likely-benign' else 'likely-real' end as label from s join f using (artifact, rule) group by artifact, rule""")
def triage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of replies on the findings of ten documents each; the reason is the whole text, redacted and clipped."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("artifact", F.floor(F.col("doc_id") / 10))
    one = F.struct(F.concat(F.lit("R-"), F.col("doc_id") % 7).alias("rule_id"), pick(_SAID, F.col("doc_id")).alias("label"), F.coalesce("text", F.lit("")).alias("reason"))
    said = d.select("artifact", F.concat(F.lit("Labels: "), F.to_json(F.struct(F.array(one).alias("labels")))).alias("reply"))
    findings = d.filter("text is not null").select("artifact", F.concat(F.lit("R-"), F.length("text") % 7).alias("rule"))
    return replies.triage(said, findings).select("artifact", "rule", "label")


_USERS = ("", "", "user:a pass@", "key@", "a@b:c@", ":@")


@query(r"""with u as (select page_id, regexp_replace(url, '://', '://' || ['', '', 'user:a pass@', 'key@', 'a@b:c@', ':@'][page_id % 6 + 1]) as url from pages),
s as (select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://') as scheme, regexp_extract(url, '^[^#?]*') as near, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) as q, regexp_extract(url, '#.*') as frag from u),
a as (select *, regexp_extract(near[length(scheme) + 1 :], '^[^/]*') as auth from s)
select page_id, scheme || case when contains(auth, '@') then '[redacted]@' || regexp_extract(auth, '[^@]*$') else auth end || near[length(scheme) + length(auth) + 1 :] ||
  case when regexp_matches(url, '^[^#?]*\?') then '?' || array_to_string(list_transform(string_split(q, '&'), lambda p: case when p = '' or p like '%=' and length(p) - length(replace(p, '=', '')) = 1 then p when contains(p, '=') then split_part(p, '=', 1) || '=[redacted]' else '[redacted]' end), '&') else '' end ||
  case when length(frag) > 1 then '#[redacted]' else frag end as shown from a""")
def shown_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = pick(_USERS, F.col("page_id"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("://"), F.concat(F.lit("://"), user)).alias("url"))
    return pages.select("page_id", redaction.endpoint("url").alias("shown"))


_FLAGS = ("--token", "-u", "--api-key", "--name", "--db.password", "--tokens-max", "--proxy-user")


@query()
def shown_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of whole texts as arguments behind flags. Without SQL: tests/test_redaction.py holds it against brute force."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    args = F.flatten(F.transform(lines, lambda x, i: F.array(F.element_at(F.array(*map(F.lit, _FLAGS)), (i % len(_FLAGS)).cast("int") + 1), x)))
    return d.select("doc_id", args.alias("args")).select("doc_id", redaction.argv("args").alias("shown"))
