"""The queries of this subpackage over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import table
from .decontaminate import decontaminate
from .license_scan import TEMPLATES, license_scan
from .lm_score import lm_score
from .mixing import MixRule, mix
from .ngram_join import JoinRule, ngram_jaccard_join
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .token_store import token_store
from .toxicity import toxicity


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), JoinRule(words=3, num=9, den=10)).drop("text_hash", "group")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the positions of the first and the last pass, in the place of the list of all."""
    return mix(table(spark, sf_dir, "documents")).withColumn("last_position", F.try_element_at("positions", F.lit(-1))).drop("positions")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_join, op2_token_counts, op3_license_scan, op4_substring_dedup, op5_decontaminate, op6_token_store, op7_toxicity, op8_mix, op9_nearest, op10_lm_score, pipeline)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[^\x20\x09-\x0D]+"

_OP1 = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as ss from w),
u as (select doc_id, len(ss) as n, unnest(ss) as g from s),
l as (
  select a.doc_id as a, b.doc_id as b from u a join u b on a.g = b.g and a.doc_id != b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (select doc_id, doc_id as c from s union select l.a, r.c from r join l on r.doc_id = l.b)
select s.doc_id, len(s.ss)::bigint as n_shingles, min(r.c) as component_id from s join r on s.doc_id = r.doc_id group by s.doc_id, s.ss
"""

_OP3 = f"""
with t(name, words) as (values {", ".join(f"('{k}', regexp_extract_all(translate('{v}', '{_UPPER}', '{_LOWER}'), '[a-z0-9]+'))" for k, v in sorted(TEMPLATES.items()))}),
tg as (select name, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as g from t),
b0 as (select doc_id, replace(replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as x from documents),
b1 as (select doc_id, unnest(regexp_split_to_array(x, '\\n[ \\t]*\\n\\s*')) as line from b0),
l as (
  select doc_id, false as wrapped, unnest(string_split(x, chr(10))) as line from b0
  union all select doc_id, true, line from b1 where len(list_filter(string_split(line, chr(10)), lambda y: regexp_matches(y, '[a-z0-9]'))) > 1),
w as (select doc_id, wrapped, row_number() over () as k, regexp_extract_all(line, '[a-z0-9]+') as ws from l),
g as (
  select doc_id, wrapped, k, list_distinct(case when len(ws) < 2 then [] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w where len(ws) > 0),
d as (
  select g.doc_id, g.wrapped, g.k, tg.name, len(list_intersect(g.g, tg.g)) * 2.0::double / (len(g.g) + len(tg.g)) as dice from g join tg on len(g.g) > 0 and len(g.g) * 4 <= len(tg.g) * 6 + 4 and len(tg.g) * 4 <= len(g.g) * 6 + 4),
b as (select doc_id, wrapped, k, min({{'d': -dice, 'name': name}}) as m from d where dice >= 0.8 group by doc_id, wrapped, k),
n as (select doc_id, count(*) filter (not wrapped) as n from g group by doc_id),
h as (select doc_id, count(*) filter (not wrapped) as n, count(*) filter (wrapped) as blocks, min(m) as m from b group by doc_id)
select documents.doc_id, coalesce(n.n, 0)::bigint as n_lines, coalesce(h.n, 0)::bigint as n_license_lines, coalesce(h.blocks, 0)::bigint as n_license_blocks, h.m.name as license, -h.m.d as dice
from documents left join n on documents.doc_id = n.doc_id left join h on documents.doc_id = h.doc_id
"""

_OP4 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') as ws from documents),
x as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w),
k as (select doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) as k from x),
m as (select k, min(doc_id) as first_doc from k group by k),
c as (select distinct doc_id, unnest(range(i, i + 50)) as p from k join m using (k) where doc_id > first_doc),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from w),
q as (
  select p.doc_id, count(c.p) as gone, string_agg(p.ws[p.p], ' ' order by p.p) filter (where c.p is null) as kept
  from p left join c on p.doc_id = c.doc_id and p.p = c.p group by p.doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(q.gone, 0)::bigint as n_removed, sha256(coalesce(q.kept, '')) as kept_sha256
from w left join q on w.doc_id = q.doc_id
"""

_OP5 = rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bi as (select item_id, ws, least(len(ws), 13) as n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0),
bk as (select distinct item_id, n, array_to_string(ws[i : i + n - 1], ' ') as k from bi),
ns as (select distinct n from bk),
wi as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w join ns on len(ws) >= n),
f as (select wi.doc_id, wi.i, wi.n, bk.item_id from wi join bk on wi.n = bk.n and array_to_string(wi.ws[wi.i : wi.i + wi.n - 1], ' ') = bk.k),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from f) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, item_id::varchar as s from f) group by doc_id)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.ws) as contaminated
from w left join h on w.doc_id = h.doc_id left join t on w.doc_id = t.doc_id
"""

_MIX = MixRule()
_OP8 = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_BLANK}'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as place from documents),
e as (select *, ('0x' || substr(place, 1, 8))::bigint % {_MIX.buckets} as bucket from d),
s as (select source, sum(size)::bigint as source_size from e group by source),
k as (select *, row_number() over (order by source nulls last) - 1 as r from s),
a as (
  select source, source_size, [3.0::double, 1.0::double, 2.0::double][r % 3 + 1] as weight, case when r % 2 = 0 then 1.0::double else -1.0::double end as late, source_size * 2.0::double as most from k),
b as (
  select *, coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as held,
    sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as open,
    least(sum(source_size) over () * 1.5::double, sum(most) over ()) as demand from a),
c as (select min({{'k': most / weight, 'water': (demand - held) / open}}) filter (where (demand - held) / open * weight < most) as x from b),
t as (select source, source_size, late * {_MIX.tilt}::double as a, case when c.x is null then most else least(most, c.x.water * weight) end as target from b, c),
p as (
  select e.*, coalesce(sum(size) over (partition by source order by bucket, place, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from e),
q as (
  select p.doc_id, p.size, t.source_size, t.target, t.a, start, (case when size > 0 and start + size / 2.0::double < target then 1 else 0 end)
    + (case when size > 0 and start + size / 2.0::double + source_size < target then 1 else 0 end) as passes
  from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target, (passes * size)::bigint as taken,
  case when passes > 0 then (sqrt((1.0::double - a) * (1.0::double - a) + 4.0::double * a * least(1.0::double, start / target)) - (1.0::double - a)) / (2.0::double * a) end as position,
  case when passes > 0 then (sqrt((1.0::double - a) * (1.0::double - a) + 4.0::double * a * least(1.0::double, (start + (passes - 1) * source_size) / target)) - (1.0::double - a))
    / (2.0::double * a) end as last_position
from q
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1, "op3_license_scan": _OP3, "op4_substring_dedup": _OP4, "op5_decontaminate": _OP5, "op8_mix": _OP8}
