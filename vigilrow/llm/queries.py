"""The registered queries op1 to op10, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilrow.llm import centroids, chat_format, decontaminate, embedding_dedup, exact_dedup, language_id, line_dedup, lm_scoring, ngram_join, packing, periodic_runs, suffix_dedup, toxicity
from vigilrow.llm.common import fold, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), F.expr(fold("doc_id", "5")) != 0)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (F.expr(fold("doc_id", "5")) == 0).alias("held_out"), "score", "predicted")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return decontaminate.digest(found)


ORACLE_SQL["op8_decontamination"] = r"""
with d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where text is not null and item_id is not null),
p as (select distinct item_id, len(w[k : k + 9]) as n, array_to_string(w[k : k + 9], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
n as (select distinct n from p),
q as (select r, k, n, array_to_string(w[k : k + n - 1], ' ') as s from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, n where len(w) >= n)),
h as (select r, item_id, k, n from q join p using (n, s)),
c as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from (select distinct r, k, n from h)) group by r),
i as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join i using (r)
"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False)


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


#: Documents that link share a word set within the size bounds; pairs come from their rarest shingles.
ORACLE_SQL["op5_ngram_join"] = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (s) where x.doc_id < y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.b from r join e on e.a = r.y),
m as (select x as doc_id, min(y) as component_id from r group by x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents left join n using (doc_id) join m using (doc_id)
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    return chat_format.digest(chat_format.format_conversations(rows))


#: Lengths follow from the template: 9 characters around a conversation, 23 around a turn, 2 for each escaped string and 1 for a backslash.
ORACLE_SQL["op9_chat_format"] = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
x as (select *, len(regexp_extract_all(role || chr(10) || text, '<[|]turn[|]>|<[|]text[|]>|<[|]end[|]>|<s>|</s>|\[INST\]|\[/INST\]')) * 2 + len(regexp_extract_all(role || text, '\\')) as more from c)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (7 + sum(23 + length(role) + length(text) + more))::bigint as formatted_chars
from x group by conv_id
"""


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: All pairs of a label in double precision.
ORACLE_SQL["op2_embedding_dedup"] = """
with recursive v as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from (select vec_id, label, embedding::double[] as e from embeddings)),
u as (select * from v where label is not null and n > 0 and isfinite(n) and len(list_filter(e, lambda x: x is null)) = 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r as (select vec_id as x, vec_id as y from embeddings union select r.x, l.b from r join l on l.a = r.y),
m as (select x as vec_id, min(y) as component_id from r group by x),
c as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join m using (vec_id) left join c using (vec_id)
"""


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = lm_scoring.fit_and_score(documents, F.expr(fold("doc_id", "5")) != 1)
    return scored.withColumn("held_out", F.expr(fold("doc_id", "5")) == 1)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(documents, F.expr(fold("doc_id", "4")) != 2)
    return language_id.predict(documents, model).withColumn("held_out", F.expr(fold("doc_id", "4")) == 2)


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.dedup(documents, text_sha256=F.sha2(exact_dedup.normalised().cast("binary"), 256))


ORACLE_SQL["op11_exact_dedup"] = r"""
with d as (select doc_id, row_number() over () as r, coalesce(length(text), 0) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id nulls last, r)
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def _rounds() -> str:
    """Every distance to every centroid, four times."""
    steps = []
    for k in range(4):
        steps.append(f"""a{k} as (select r, min_by(c, (far, c)) as c, min(far) as far from (select r, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far from v, c{k}) group by r)""")
        if k < 3:
            steps.append(f"""s{k} as (select c, d, sum(x)::bigint as s, count(*)::bigint as n from (select c, unnest(v) as x, unnest(range(1, 65)) as d from a{k} join v using (r)) group by c, d),
n{k} as (select c, list((s - ((s % n) + n) % n) // n order by d) as m from s{k} group by c),
c{k + 1} as (select c, coalesce(n{k}.m, c{k}.m) as m from c{k} left join n{k} using (c))""")
    return ",\n".join(steps)


ORACLE_SQL["op12_centroids"] = f"""
with e as (select vec_id, row_number() over () as r, embedding::double[] as x from embeddings where len(embedding) = 64),
v as (select vec_id, r, list_transform(x, lambda y: floor(64 * y)::bigint) as v from e where len(list_filter(x, lambda y: y is not null and isfinite(y))) = 64),
c0 as (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as c, v as m from v qualify c < 16),
{_rounds()},
t as (select c, sum(far)::bigint as s from a3 group by c)
select vec_id, c as cluster, far as distance, s as cluster_inertia, (select sum(s)::bigint from t) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a3 join v using (r) join t using (c) join c3 using (c)
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return periodic_runs.digest(periodic_runs.find(documents.withColumn("text", repeated_tail())))


def repeated_tail() -> Column:
    """The text; of a tenth of the documents, chosen by doc_id, its words with a tail that repeats one part of them."""
    words = F.expr(r"filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')")
    n = F.size(words)
    g = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 10")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    chosen = (F.expr(fold("doc_id", "10")) == 0) & (n > 0)
    return F.when(chosen, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col("text"))
