"""Queries of every operator over relations derived from the synthetic tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mods import decode_column, lift_column, phred_column, positions_column
from ..functions.motifs import code_label_column, normal_label_column, occurrences, parse_motif
from ..operators import calls as C
from ..operators import clustering as K
from ..operators import comparison as P
from ..operators import haplotypes as H
from ..operators import latent_classes as L
from ..sources.tables import assigned_class, fixed, safe_names
from ..streaming.sites import stream_site_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# relations that both engines derive alike

READS = """reads as (select doc_id as read_id, source as contig, case when doc_id % 2 = 0 then '+' else '-' end as strand,
  upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) as seq from documents)"""
CALLS = """calls as (select event_id as call_ord, user_id as read_id, event_type as motif, 'c' || (user_id % 5) as contig, floor(epoch(ts) / 3600)::bigint as ref_pos,
  json_extract_string(props, '$.k')::int as ml, event_id % 7 <> 0 as methylated,
  case when event_id % 7 <> 0 then (json_extract_string(props, '$.k')::int / 255.0::double)::float end as prob from events)"""
FEATURES = """features as (select vec_id as row_ord, label, d as dim, case when (vec_id * 7 + d * 3) % 10 <> 0 then embedding[d + 1]::double end as value
  from embeddings, (select unnest(range(0, 64)) as d))"""
TYPED = """typed as (select o_orderkey as row_ord, case when o_orderkey % 11 <> 0 then case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end end as c0,
  case when o_orderkey % 13 <> 0 then substr(o_orderpriority, 1, 1)::int - 1 end as c1, case when o_orderkey % 7 <> 0 then o_totalprice / 500000.0::double end as x from orders)"""
BLOCKS = "blocks as (select p_partkey as block_ord, p_partkey as snp_start, p_partkey + p_size as snp_end from part)"


def reads_of(spark: SparkSession, d: str) -> DataFrame:
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", ""))
    return _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.col("source").alias("contig"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), seq.alias("seq"))


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    ml, called = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 7 != 0
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return _table(spark, d, "events").select(
        F.col("event_id").alias("call_ord"), F.col("user_id").alias("read_id"), F.col("event_type").alias("motif"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("contig"),
        hour.alias("ref_pos"), ml.alias("ml"), called.alias("methylated"), F.when(called, (ml / F.lit(255.0)).cast("float")).alias("probability"),
    )


def features_of(spark: SparkSession, d: str) -> DataFrame:
    cells = F.transform("embedding", lambda v, k: F.when((F.col("vec_id") * 7 + k * 3) % 10 != 0, v.cast("double")))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("row_ord"), "label", cells.alias("features"))


def typed_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c0 = F.when(k % 11 != 0, F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    c1 = F.when(k % 13 != 0, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    x = F.when(k % 7 != 0, F.col("o_totalprice") / 500000.0)
    return _table(spark, d, "orders").select(k.alias("row_ord"), k.cast("string").alias("id"), F.array(c0, c1).cast("array<int>").alias("cats"), F.array(x).alias("meth"))


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").alias("block_ord"), F.col("p_partkey").alias("snp_start"), (F.col("p_partkey") + F.col("p_size")).alias("snp_end"))


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


_MOTIF = parse_motif("RNNA_6mA_3")


@query(f"with {READS} select read_id, i as motif_start from (select read_id, seq, unnest(range(0, greatest(length(seq) - 3, 0))) as i from reads) where regexp_matches(substr(seq, i + 1, 4), '^[AG]..A$')")
def motif_occurrences(spark, d):
    return occurrences(reads_of(spark, d), [_MOTIF]).select("read_id", F.col("motif_start").cast("long").alias("motif_start"))


@query(f"""with {READS}, o as (select read_id, strand, seq, unnest(range(0, greatest(length(seq) - 3, 0))) as i from reads)
select read_id, i as motif_start, i + case when strand = '-' then 0 else 3 end as read_position from o where regexp_matches(substr(seq, i + 1, 4), '^[AG]..A$')""")
def motif_offsets_strand(spark, d):
    return occurrences(reads_of(spark, d), [_MOTIF]).select("read_id", F.col("motif_start").cast("long").alias("motif_start"), F.col("read_position").cast("long").alias("read_position"))


def _tagged(spark, d):
    k = F.col("read_id")
    mark = F.when(k % 3 == 0, ".").when(k % 3 == 1, "?").otherwise("")
    mm = F.concat(F.when(k % 5 == 0, "A-a").otherwise("A+a"), mark, F.lit(","), k % 4, F.lit(","), k % 2, F.lit(",1;"))
    return reads_of(spark, d).select("*", mm.alias("mm"), F.array(F.lit(200), F.lit(100), (k % 100).cast("int")).alias("ml"))


_DECODED = f"""with {READS},
p as (select read_id, seq, list_filter(range(0, length(seq)), lambda i: substr(seq, i + 1, 1) = 'A') as fwd from reads),
q as (select read_id, case when read_id % 5 = 0 then list_reverse(fwd) else fwd end as places, [read_id % 4, read_id % 4 + 1 + read_id % 2, read_id % 4 + 1 + read_id % 2 + 2] as ix from p),
g as (select *, len(places) > ix[3] as good from q),
c as (
  select read_id, k - 1 as ordinal, places[ix[k] + 1] as position, true as methylated, ([200, 100, read_id % 100][k] / 255.0::double)::float as probability
  from g, (select unnest(range(1, 4)) as k) where good
  union all
  select read_id, 3 + row_number() over (partition by read_id order by k) - 1, places[k + 1], false, null from (
    select *, unnest(range(0, len(places))) as k from g where good and read_id % 3 <> 1) where not list_contains(ix, k))"""


@query(_DECODED + " select read_id, ordinal::int as ordinal, position::int as position, methylated, round(probability::double, 6) as probability from c")
def decode_modifications(spark, d):
    c = _tagged(spark, d).select("read_id", F.explode(decode_column(F.col("seq"), F.col("mm"), F.col("ml"))["calls"]).alias("c"))
    return c.select("read_id", "c.ordinal", "c.position", "c.methylated", _r(F.col("c.probability").cast("double"), "probability"))


@query(f"with {READS} select read_id, unnest(list_filter(range(0, length(seq)), lambda i: substr(seq, i + 1, 1) = 'C')) as position from reads")
def canonical_positions(spark, d):
    return reads_of(spark, d).select("read_id", F.explode(positions_column(F.col("seq"), "C", F.lit("+"))).alias("position"))


@query(_DECODED + ", n as (select read_id, count(*) as n from c where not methylated group by read_id) select g.read_id, not good as failed, coalesce(n.n, 0) as implicit from g left join n on g.read_id = n.read_id")
def implicit_unmodified(spark, d):
    s = _tagged(spark, d).select("read_id", decode_column(F.col("seq"), F.col("mm"), F.col("ml")).alias("d"))
    return s.select("read_id", F.col("d.error").isNotNull().alias("failed"), F.size(F.filter("d.calls", lambda c: ~c["methylated"])).cast("long").alias("implicit"))


@query(f"""with {READS}, p as (select *, 100 + read_id % 50 as start, unnest(range(0, length(seq))) as i from reads where length(seq) >= 20)
select read_id, i as read_position, case when i < 3 then null when i < 10 then start + i - 3 when i < 12 then null when i < length(seq) - 4 then start + i - 5 + 6 end as ref_position from p""")
def cigar_lift_over(spark, d):
    n = F.length("seq")
    r = reads_of(spark, d).where(n >= 20).withColumn("cigar", F.concat(F.lit("3S7M2I6D"), n - 16, F.lit("=4S")))
    lifted = r.select("read_id", F.posexplode(lift_column(n, 100 + F.col("read_id") % 50, F.col("cigar"))).alias("i", "ref_position"))
    return lifted.select("read_id", F.col("i").cast("long").alias("read_position"), "ref_position")


_LABELS = """select p_partkey, case when base = 'A' and code = 'a' then '6mA' when base = 'C' and code = 'm' then '5mC' when base = 'C' and code in ('21839', 'C') then '4mC' when base = 'C' and code = 'h' then '5hmC'
    when base = 'C' and code = 'f' then '5fC' when base = 'C' and code = 'g' then '5gmC' else base || '+' || code end as label,
  case lower(code) when 'a' then '6mA' when 'm' then '5mC' when 'h' then '5hmC' when 'f' then '5fC' when 'g' then '5gmC' when 'c' then '4mC' else code end as normal
from (select p_partkey, case when p_partkey % 2 = 0 then 'A' else 'C' end as base, ['a', 'm', '21839', 'C', 'h', 'f', 'g', 'zz'][p_partkey % 8 + 1] as code from part)"""


@query(_LABELS)
def mod_label_normalize(spark, d):
    codes = F.array(*map(F.lit, ["a", "m", "21839", "C", "h", "f", "g", "zz"]))
    rows = _table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("C").alias("base"), F.element_at(codes, (F.col("p_partkey") % 8 + 1).cast("int")).alias("code"))
    return rows.select("p_partkey", code_label_column(F.col("base"), F.col("code")).alias("label"), normal_label_column(F.col("code")).alias("normal"))


_JOIN = f"""with {CALLS}, o as (select distinct read_id, motif, ref_pos from calls where call_ord % 3 <> 0),
f as (select read_id, motif, ref_pos, arg_min(ml, call_ord) as ml, arg_min(methylated, call_ord) as methylated from calls where call_ord % 5 <> 0 group by all)"""


def _join_sides(spark, d):
    c = calls_of(spark, d)
    return c.where("call_ord % 3 != 0").select("read_id", "motif", "ref_pos").distinct(), c.where("call_ord % 5 != 0").select("read_id", "motif", "ref_pos", "call_ord", "ml", "methylated")


@query(_JOIN + " select read_id, motif, ref_pos, ml, methylated from o join f using (read_id, motif, ref_pos)")
def first_call_join(spark, d):
    o, c = _join_sides(spark, d)
    keys = ["read_id", "motif", "ref_pos"]
    return o.join(C.first_calls(c, keys, "call_ord"), keys).select(*keys, "ml", "methylated")


@query(_JOIN + " select read_id, motif, ref_pos, ml, coalesce(methylated, false) as methylated from o left join f using (read_id, motif, ref_pos)")
def left_call_join(spark, d):
    o, c = _join_sides(spark, d)
    keys = ["read_id", "motif", "ref_pos"]
    return C.match_calls(o, c.withColumnRenamed("call_ord", "ordinal"), keys, "left").select(*keys, "ml", "methylated")


@query(f"""with {CALLS} select read_id, motif, count(*) as call_count, round(avg(prob::double), 6) as mean_probability,
  {', '.join(f'round(quantile_cont(prob::double, {k / 10}), 6) as quantile_{10 * k}' for k in range(11))} from calls group by read_id, motif""")
def per_read_aggregate(spark, d):
    a = C.quantile_columns(C.read_aggregate(calls_of(spark, d), ["read_id", "motif"]))
    return a.select("read_id", "motif", "call_count", _r("mean_probability", "mean_probability"), *(_r(f"quantile_{10 * k}", f"quantile_{10 * k}") for k in range(11)))


_KINDS = ["click", "view", "purchase", "signup", "logout", "login", "error"]


@query(f"""with {CALLS}, k as (select unnest({_KINDS}) as motif, unnest(range(0, {len(_KINDS)})) as o), r as (select distinct read_id from calls),
h as (select distinct read_id, motif from calls where methylated)
select r.read_id, coalesce(string_agg(k.motif, '+' order by k.o), 'NONE') as combo from r left join h on r.read_id = h.read_id left join k on h.motif = k.motif group by r.read_id""")
def motif_hits_combo(spark, d):
    c = calls_of(spark, d)
    return C.motif_hits(c, c, "read_id", _KINDS).select("read_id", C.combo_label(F.col("hits"), _KINDS).alias("combo"))


@query(f"""with {CALLS}, a as (select read_id, call_ord % 4 as read_ord, motif, avg(prob::double) as m from calls group by all),
l as (select read_id, motif, arg_max(m, read_ord) as m from a where m is not null group by all),
r as (select distinct read_id from l)
select r.read_id, {', '.join(f"round(max(case when l.motif = '{k}' then l.m end), 6) as f{i}" for i, k in enumerate(_KINDS))} from r join l on r.read_id = l.read_id group by r.read_id""")
def feature_pivot(spark, d):
    a = C.read_aggregate(calls_of(spark, d).withColumn("read_ord", F.col("call_ord") % 4), ["read_id", "read_ord", "motif"])
    m = C.hit_reads(C.feature_matrix(a, _KINDS))
    return m.select("read_id", *(_r(F.col("features")[i], f"f{i}") for i in range(len(_KINDS))))


@query(f"with {FEATURES} select dim::int as dim, count(*) - count(value) as n_missing, round(coalesce(avg(value), 0.5), 6) as mean, (count(*) - count(value)) / count(*) <= 0.1 as kept from features group by dim")
def dense_columns(spark, d):
    return C.dense_columns(features_of(spark, d), 0.1).select("dim", "n_missing", _r("mean", "mean"), "kept")


_HIT = "(methylated and (prob is null or prob >= 0.2::float))"


@query(f"""with {CALLS} select contig, ref_pos, motif, count(*) filter ({_HIT}) as meth, count(*) filter (not {_HIT}) as unmeth, round(avg(prob::double) filter ({_HIT}), 6) as mean_probability,
  round(count(*) filter ({_HIT}) / count(*), 6) as fraction from calls group by all""")
def site_summary(spark, d):
    s = C.site_summary(calls_of(spark, d), ["contig", "ref_pos", "motif"], 0.2)
    return s.select("contig", "ref_pos", "motif", "meth", "unmeth", _r("mean_probability", "mean_probability"), _r("fraction", "fraction"))


_STATES = f"""with {CALLS}, s as (select contig, floor(ref_pos / 24)::bigint as block, ref_pos, motif, read_id, arg_max(case when {_HIT} then 'M' else 'U' end, call_ord) as state from calls group by all)"""


def _states(spark, d):
    return C.block_states(calls_of(spark, d).withColumnRenamed("ref_pos", "ref_position").withColumnRenamed("motif", "motif_idx"), 24, 0.2)


@query(_STATES + """, t as (select contig, block, list_sort(list_distinct(list({'p': ref_pos, 'm': motif}))) as sites from s group by all),
u as (select contig, block, unnest(sites) as site, generate_subscripts(sites, 1) as k from t), r as (select distinct contig, block, read_id from s),
p as (select r.contig, r.block, r.read_id, string_agg(coalesce(s.state, '.'), '' order by u.k) as pattern from r join u on r.contig = u.contig and r.block = u.block
  left join s on s.contig = r.contig and s.block = r.block and s.read_id = r.read_id and s.ref_pos = u.site.p and s.motif = u.site.m group by all)
select contig, block, pattern, count(*) as n from p group by all""")
def block_patterns(spark, d):
    return C.block_patterns(_states(spark, d))


@query(_STATES + """, r as (select contig, block, read_id, count(*) filter (state = 'M') as m, count(*) as n from s group by all),
t as (select contig, block, count(distinct (ref_pos, motif)) as n_sites from s group by all)
select r.contig, r.block, count(*) as total_reads, count(*) filter (m = n) as fully_methylated, count(*) filter (m = 0) as fully_unmethylated, count(*) filter (m > 0 and m < n) as mixed,
  round(avg(m / n), 6) as mean_fraction, round(var_pop(m / n), 6) as variance, round(avg(least(abs(m / n - 0.5::double) * 2, 1.0::double)), 6) as polarization, any_value(n_sites) as n_sites
from r join t on r.contig = t.contig and r.block = t.block group by r.contig, r.block""")
def block_stats(spark, d):
    s = C.block_stats(_states(spark, d))
    return s.select("contig", "block", "total_reads", "fully_methylated", "fully_unmethylated", "mixed", _r("mean_fraction", "mean_fraction"), _r("variance", "variance"), _r("polarization", "polarization"), "n_sites")


_PILE = f"""with {READS}, p as (select contig, read_id % 50 + i as position, substr(seq, i + 1, 1) as base from (select *, unnest(range(0, length(seq))) as i from reads)),
c as (select contig, position, count(*) filter (base = 'A') as "A", count(*) filter (base = 'C') as "C", count(*) filter (base = 'G') as "G", count(*) filter (base = 'T') as "T" from p group by all)"""


def _pile(spark, d):
    r = reads_of(spark, d).where("length(seq) > 0")
    return C.pileup(r.withColumn("ref_pos", F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.col("read_id") % 50 + i)))


@query(_PILE + ' select contig, position, "A", "C", "G", "T" from c')
def pileup_counts(spark, d):
    return _pile(spark, d)


@query(_PILE + """, o as (select contig, position, ['A', 'C', 'G', 'T'][position % 4 + 1] as original, [{'n': "A", 'b': 'A'}, {'n': "C", 'b': 'C'}, {'n': "G", 'b': 'G'}, {'n': "T", 'b': 'T'}] as x from c)
select contig, position, original, list_sort(list_filter(x, lambda e: e.b <> original))[1].b as replacement from o""")
def replacement_base(spark, d):
    original = F.element_at(F.array(*map(F.lit, C.BASES)), (F.col("position") % 4 + 1).cast("int"))
    p = _pile(spark, d).withColumn("original", original)
    return p.select("contig", "position", "original", C.replacement_base(F.col("original"), {b: F.col(b) for b in C.BASES}).alias("replacement"))


@query(f"with {CALLS} select call_ord, case when ml / 100.0::double >= 1.0 - 1.1920929e-07 then 93 else least(93, greatest(0, floor(-10.0::double * log10(greatest(1.0::double - ml / 100.0::double, 1e-9::double)) + 0.5::double))) end::int as quality from calls")
def phred_quality(spark, d):
    return calls_of(spark, d).select("call_ord", phred_column(F.col("ml") / F.lit(100.0)).alias("quality"))


_NN = f"""with {FEATURES}, w as (select row_ord, list(value order by dim) as f from features group by row_ord),
m as (select row_ord, dim from features where value is null), c as (select dim, avg(value) as mean from features group by dim),
d as (select m.row_ord, m.dim, b.row_ord as o, v.value, list_filter(list_transform(range(1, 65), lambda k: case when k - 1 = m.dim then null else a.f[k] - b.f[k] end), lambda x: x is not null) as g
  from m join w a on a.row_ord = m.row_ord join features v on v.dim = m.dim and v.value is not null join w b on b.row_ord = v.row_ord),
n as (select row_ord, dim, arg_min(value, {{'d': sqrt(list_sum(list_transform(g, lambda x: x * x)) / len(g)), 'o': o}}) as near from d where len(g) > 0 group by row_ord, dim)
select m.row_ord, m.dim::int as dim, round(coalesce(n.near, c.mean, 0.5), 6) as value from m left join n on m.row_ord = n.row_ord and m.dim = n.dim join c on m.dim = c.dim"""


def _dense(spark, d):
    """Rows of a cluster matrix in id order, for the numpy kernels."""
    return features_of(spark, d).select(F.col("row_ord").alias("read_id"), "features", "label")


@query(_NN)
def nn_impute(spark, d):
    rows = _dense(spark, d)
    lacking = rows.select("read_id", F.posexplode("features").alias("dim", "was")).where("was is null").drop("was")
    filled = K.impute_rows(rows).select("read_id", F.posexplode("features").alias("dim", "value"))
    return lacking.join(filled, ["read_id", "dim"]).select(F.col("read_id").alias("row_ord"), "dim", _r("value", "value"))


@query("""with e as (select vec_id as id, label, list_transform(embedding, lambda v: v::double) as x from embeddings),
p as (select a.id, a.label, b.label as o, avg(sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) * (a.x[k] - b.x[k]))))) as d from e a join e b on a.id <> b.id group by all),
s as (select id, coalesce(max(d) filter (label = o), 0.0) as a, min(d) filter (label <> o) as b from p group by id)
select id, round(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0.0 end, 6) as s from s""")
def silhouette_given_labels(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return K.silhouette_rows(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", x.alias("x"))).select("id", _r("s", "s"))


@query(f"with {FEATURES} select label as cluster_id, dim::int as dim, count(*) as read_count, round(avg(value), 6) as centroid from features group by all")
def cluster_centroids(spark, d):
    f = _dense(spark, d)
    return K.centroids(f.select("read_id", "features"), f.select("read_id", F.col("label").alias("cluster_id"))).select("cluster_id", "dim", "read_count", _r("centroid", "centroid"))


_G = L.Params([0.6, 0.4], [[], []], [[0.3], [0.6]], [[0.04], [0.09]])
_GLOG = ", ".join(f"ln({p}::double) - 0.5::double * ln(2 * pi() * {v}::double) - (x - {m}::double) * (x - {m}::double) / (2 * {v}::double) as l{c}" for c, (p, m, v) in enumerate(((0.6, 0.3, 0.04), (0.4, 0.6, 0.09))))
_GSQL = f"""with {TYPED}, l as (select row_ord, x, {_GLOG} from typed where x is not null),
r as (select row_ord, x, exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) as r0, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) as ll from l)"""


def _gauss(spark, d):
    rows = typed_of(spark, d).where("meth[0] is not null").withColumn("cats", F.array().cast("array<int>"))
    return L.e_step(rows, _G)


@query(_GSQL + " select row_ord, round(r0, 6) as r0, round(ll, 6) as ll from r")
def gmm_estep_fixed(spark, d):
    return _gauss(spark, d).select("row_ord", _r(F.col("resp")[0], "r0"), _r("ll", "ll"))


@query(_GSQL + """, m as (select sum(r0) as n0, count(*) - sum(r0) as n1, sum(r0 * x) / sum(r0) as m0, sum((1 - r0) * x) / sum(1 - r0) as m1 from r)
select round(n0 / (n0 + n1), 6) as weight, round(m0, 6) as mean, round((select sum(r0 * (x - m0) * (x - m0)) / sum(r0) from r), 6) as variance from m
union all select round(n1 / (n0 + n1), 6), round(m1, 6), round((select sum((1 - r0) * (x - m1) * (x - m1)) / sum(1 - r0) from r), 6) from m""")
def gmm_mstep_fixed(spark, d):
    p = L.m_step(L.statistics(_gauss(spark, d), _G), _G, L.Priors(0.0, 0.0))
    return spark.createDataFrame([(round(p.pi[c], 6), round(p.mean[c][0], 6), round(p.var[c][0], 6)) for c in range(2)], "weight double, mean double, variance double")


def _clustered(spark, d, how):
    return K.cluster_rows(K.impute_rows(_dense(spark, d)), how)


@query()
def gmm_labels(spark, d):
    return _clustered(spark, d, "gmm")


@query()
def single_linkage(spark, d):
    return _clustered(spark, d, "agglomerative")


@query()
def hdbscan_labels(spark, d):
    return _clustered(spark, d, "hdbscan")


_SEG = f"""with {BLOCKS}, b as (select distinct unnest([snp_start, snp_end + 1]) as b from blocks), s as (select b as seg_start, lead(b) over (order by b) - 1 as seg_end from b),
c as (select seg_start, seg_end, block_ord, row_number() over (partition by seg_start order by block_ord) - 1 as level, count(*) over (partition by seg_start) as n_levels
  from s join blocks on snp_start <= seg_start and snp_end >= seg_end where seg_end is not null)"""


@query(_SEG + " select seg_start, seg_end, block_ord, level::int as level, n_levels from c where n_levels > 1")
def hap_segments(spark, d):
    return H.covering_blocks(blocks_of(spark, d), 16)


@query(_SEG + """, e as (select block_ord, 'r' || (block_ord % 60) as id, snp_start + block_ord % 3 as start, greatest(snp_start + block_ord % 3, snp_end - block_ord % 5) as stop from blocks)
select id, seg_start, seg_end, min(level)::int as level from e join c using (block_ord) where n_levels > 1 and start <= seg_end and stop >= seg_start group by all""")
def hap_assign(spark, d):
    b = blocks_of(spark, d)
    e = b.select("block_ord", F.concat(F.lit("r"), F.col("block_ord") % 60).alias("id"), (F.col("snp_start") + F.col("block_ord") % 3).alias("start"), "snp_end").withColumn("end", F.greatest("start", F.col("snp_end") - F.col("block_ord") % 5))
    parts = H.shares(b, 16)
    return H.assign_levels(e, H.covering_blocks(b, 16, parts), parts)


@query("""with h as (select row_number() over (order by o_orderkey) - 1 as row_ord, o_custkey::varchar as id, o_orderkey as v from orders where o_orderkey in (select min(o_orderkey) from orders group by o_custkey)),
f as (select c_custkey::varchar as id, c_acctbal as m from customer ),
b as (select coalesce(h.id, f.id) as id, h.row_ord, h.v, f.m from h full join f on h.id = f.id)
select coalesce(row_ord, (select count(*) from h) + row_number() over (partition by row_ord is null order by id) - 1) as row_ord, id, (v % 3)::int as cat, m as meth from b""")
def dataset_outer_merge(spark, d):
    first = _table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("v"))
    h = first.select((F.row_number().over(Window.orderBy("v")) - 1).cast("long").alias("row_ord"), F.col("o_custkey").cast("string").alias("id"), F.array((F.col("v") % 3).cast("int")).alias("cats"))
    f = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array("c_acctbal").alias("meth"))
    return H.outer_merge(h, f, 1, 1).select("row_ord", "id", F.col("cats")[0].alias("cat"), F.col("meth")[0].alias("meth"))


_P = L.Params([0.5, 0.5], [[[0.5, 0.3, 0.2], [0.2, 0.2, 0.2, 0.2, 0.2]], [[0.2, 0.6, 0.2], [0.1, 0.1, 0.2, 0.3, 0.3]]], [[0.3], [0.5]], [[0.05], [0.04]])
_ELOG = ", ".join(
    f"ln({_P.pi[c]}::double) + coalesce(ln(({_P.phi[c][0]}::double[])[c0 + 1]), 0) + coalesce(ln(({_P.phi[c][1]}::double[])[c1 + 1]), 0) + coalesce(-0.5::double * ln(2 * pi() * {_P.var[c][0]}::double) - (x - {_P.mean[c][0]}::double) * (x - {_P.mean[c][0]}::double) / (2 * {_P.var[c][0]}::double), 0) as l{c}"
    for c in range(2)
)
_ESQL = f"""with {TYPED}, l as (select row_ord, c0, c1, x, {_ELOG} from typed), t as (select *, greatest(l0, l1) as g from l),
r as (select row_ord, c0, c1, x, g + ln(exp(l0 - g) + exp(l1 - g)) as ll, exp(l0 - g) / (exp(l0 - g) + exp(l1 - g)) as r0 from t)"""


@query(_ESQL + " select row_ord, round(r0, 6) as r0, round(ll, 6) as ll from r")
def em_estep_fixed(spark, d):
    return L.e_step(typed_of(spark, d), _P).select("row_ord", _r(F.col("resp")[0], "r0"), _r("ll", "ll"))


@query(_ESQL + """, w as (select 0 as c, c0, c1, x, r0 as r from r union all select 1, c0, c1, x, 1 - r0 from r)
select c::int as class, round((sum(r) + 1) / ((select count(*) from r) + 2), 6) as pi, round((coalesce(sum(r) filter (c0 = 0), 0) + 1) / (sum(r) filter (c0 is not null) + 3), 6) as phi0,
  round((coalesce(sum(r) filter (c1 = 4), 0) + 1) / (sum(r) filter (c1 is not null) + 5), 6) as phi1, round(sum(r * x) / (sum(r) filter (x is not null)), 6) as mean,
  round(sum(r * x * x) / (sum(r) filter (x is not null)) - pow(sum(r * x) / (sum(r) filter (x is not null)), 2), 6) as variance from w group by c""")
def em_mstep_fixed(spark, d):
    p = L.m_step(L.statistics(L.e_step(typed_of(spark, d), _P), _P), _P, L.Priors())
    rows = [(c, *(round(v, 6) for v in (p.pi[c], p.phi[c][0][0], p.phi[c][1][4], p.mean[c][0], p.var[c][0]))) for c in range(2)]
    return spark.createDataFrame(rows, "class int, pi double, phi0 double, phi1 double, mean double, variance double")


@query(_ESQL + """, s as (select sum(ll) as ll, count(*) as n, sum(-r0 * ln(r0) - (1 - r0) * ln(1 - r0)) as h from r)
select 17::bigint as parameters, round(ll, 4) as ll, round(h, 4) as entropy, round(-2 * ll + 2 * 17 * ln(n), 4) as bic, round(-2 * ll + 2 * 17 * ln(n) + 2 * h, 4) as icl from s""")
def model_scores(spark, d):
    e = L.e_step(typed_of(spark, d), _P).persist()
    ll, n = e.agg(F.sum("ll"), F.count("*")).first()
    k, h = L.parameter_count(2, [3, 5], 1), L.entropy(e)
    return spark.createDataFrame([(k, round(ll, 4), round(h, 4), round(L.score(ll, n, k, h, "bic"), 4), round(L.score(ll, n, k, h, "icl"), 4))], "parameters long, ll double, entropy double, bic double, icl double")


_TABLES = {"phi0": ("c0", 3), "phi1": ("c1", 5)}
_ONE = _ESQL + """, w as (select 0 as c, c0, c1, x, r0 as r from r union all select 1, c0, c1, x, 1 - r0 from r),
m as (select c, (sum(r) + 1) / ((select count(*) from r) + 2) as pi, """ + ", ".join(
    f"(coalesce(sum(r) filter ({col} = {j}), 0) + 1) / (sum(r) filter ({col} is not null) + {n}) as {name}_{j}" for name, (col, n) in _TABLES.items() for j in range(n)
) + """, sum(r * x) / (sum(r) filter (x is not null)) as mean, sum(r * x * x) / (sum(r) filter (x is not null)) - pow(sum(r * x) / (sum(r) filter (x is not null)), 2) as var from w group by c),
g as (select row_ord, ln(pi) + """ + " + ".join(f"coalesce(ln([{', '.join(f'{name}_{j}' for j in range(n))}][{col} + 1]), 0)" for name, (col, n) in _TABLES.items()) + """
  + coalesce(-0.5::double * ln(2 * pi() * var) - (x - mean) * (x - mean) / (2 * var), 0) as l from typed cross join m),
h as (select row_ord, max(l) as top from g group by row_ord)
select round(sum(ll), 4) as ll, 2::bigint as iterations from (select any_value(top) + ln(sum(exp(l - top))) as ll from g join h using (row_ord) group by row_ord)"""


@query(_ONE)
def em_one_iteration(spark, d):
    """The log-likelihood after one E and one M step."""
    f = L.fit(typed_of(spark, d), 2, [3, 5], 1, iterations=1, begin=_P)
    return spark.createDataFrame([(round(f.ll, 4), f.iterations)], "ll double, iterations long")


@query()
def em_fit(spark, d):
    f = L.fit(typed_of(spark, d), 2, [3, 5], 1, iterations=8, seed=1)
    return L.map_assignments(f.responsibilities)


_P3 = L.Params([0.5, 0.3, 0.2], [_P.phi[0], _P.phi[1], [[0.4, 0.4, 0.2], [0.1, 0.4, 0.3, 0.1, 0.1]]], [[0.3], [0.5], [0.1]], [[0.05], [0.04], [0.02]])
_LOG3 = ", ".join(
    f"ln({_P3.pi[c]}::double) + coalesce(ln(({_P3.phi[c][0]}::double[])[c0 + 1]), 0) + coalesce(ln(({_P3.phi[c][1]}::double[])[c1 + 1]), 0) + coalesce(-0.5::double * ln(2 * pi() * {_P3.var[c][0]}::double) - (x - {_P3.mean[c][0]}::double) * (x - {_P3.mean[c][0]}::double) / (2 * {_P3.var[c][0]}::double), 0)"
    for c in range(3)
)


@query(f"""with {TYPED}, l as (select row_ord, [{_LOG3}] as l from typed), t as (select row_ord, list_transform(l, lambda v: exp(v - list_max(l))) as e from l),
r as (select row_ord, list_transform(e, lambda v: v / list_sum(e)) as r from t), m as (select c, avg(r[c]) as mean from (select r, unnest([1, 2, 3]) as c from r) group by c),
k as (select list(c order by c) as kept from m where mean >= 0.3::double or (mean = (select max(mean) from m) and (select max(mean) from m) < 0.3::double)),
o as (select row_ord, list_transform(kept, lambda c: r[c]) as own from r, k)
select row_ord::varchar as id, len(own)::int as classes, round(own[1] / list_sum(own), 6) as first, round(own[-1] / list_sum(own), 6) as last from o""")
def class_prune(spark, d):
    f = L.prune(L.fit(typed_of(spark, d), 3, [3, 5], 1, iterations=1, begin=_P3), 0.3)
    return f.responsibilities.select("id", F.size("resp").alias("classes"), _r(F.element_at("resp", 1), "first"), _r(F.element_at("resp", -1), "last"))


@query(_ESQL + f""", p as (select *, 1 - r0 as r1 from r), c as (select row_ord, c0, c1, x, [{", ".join(f"r0 * {a}::double + r1 * {b}::double" for a, b in zip(_P.phi[0][0], _P.phi[1][0]))}] as q0,
  [{", ".join(f"r0 * {a}::double + r1 * {b}::double" for a, b in zip(_P.phi[0][1], _P.phi[1][1]))}] as q1, r0 from p)
select row_ord, coalesce(c0, list_position(q0, list_max(q0)) - 1)::int as c0, coalesce(c1, list_position(q1, list_max(q1)) - 1)::int as c1, round(coalesce(x, r0 * 0.3::double + (1 - r0) * 0.5::double), 9) as x from c""")
def map_impute(spark, d):
    return L.impute(typed_of(spark, d), _P).select("row_ord", F.col("cats")[0].alias("c0"), F.col("cats")[1].alias("c1"), _r(F.col("meth")[0], "x", 9))


@query("select o_orderkey % 5 as fold, (o_orderkey % 3)::int as pseudo, count(*) as n from orders group by all")
def cv_folds_pseudo_categories(spark, d):
    rows, _ = L.pseudo_category(typed_of(spark, d), 3)
    return rows.groupBy((F.col("row_ord") % 5).alias("fold"), F.col("cats")[0].alias("pseudo")).agg(F.count("*").alias("n"))


@query("""with a as (select vec_id as id, list_transform(embedding, lambda v: round(v::double, 1)) as p from embeddings)
select id, (list_position(p, list_max(p)) - 1)::int as assigned_class from a""")
def assignment_argmax(spark, d):
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(F.round(F.col("embedding")[k].cast("double"), 1).cast("string").alias(f"class_{k}") for k in range(64)))
    return rows.select("id", assigned_class(rows.columns).alias("assigned_class"))


@query("""select d.doc_id as read_id, 'class_' || coalesce(e.label::varchar, 'unknown') as file_key from documents d left join embeddings e on d.doc_id = e.vec_id and e.vec_id % 3 <> 0""")
def fastq_class_split(spark, d):
    a = _table(spark, d, "embeddings").where("vec_id % 3 != 0").select(F.col("vec_id").alias("doc_id"), "label")
    return _table(spark, d, "documents").join(a, "doc_id", "left").select(F.col("doc_id").alias("read_id"), F.concat(F.lit("class_"), F.coalesce(F.col("label").cast("string"), F.lit("unknown"))).alias("file_key"))


def _wanted(spark):
    return spark.createDataFrame([(k, f"src{k}") for k in (1, 3, 5, 77, 99)], "ord int, contig string")


@query("with w as (select unnest([1, 3, 5, 77, 99]) as k) select k::int as ord, 'src' || k as contig from w where 'src' || k in (select source from documents)")
def contig_semi(spark, d):
    return _wanted(spark).join(_table(spark, d, "documents").select(F.col("source").alias("contig")), "contig", "left_semi").select("ord", "contig")


@query("with w as (select unnest([1, 3, 5, 77, 99]) as k) select k::int as ord, 'src' || k as contig from w where 'src' || k not in (select source from documents where source is not null)")
def contig_anti(spark, d):
    return _wanted(spark).join(_table(spark, d, "documents").select(F.col("source").alias("contig")), "contig", "left_anti").select("ord", "contig")


@query("select source as contig, doc_id as read_id from documents where source is not null qualify row_number() over (partition by source order by doc_id) <= 3")
def per_contig_limit(spark, d):
    from .extract import read_ids

    return read_ids(_table(spark, d, "documents").select(F.col("source").alias("contig"), F.col("doc_id").alias("read_id"), F.col("doc_id").alias("read_ord")), 3).select("contig", "read_id")


@query(r"""with b(bin, ord) as (values ('bin 1', 0), ('bin/1', 1), ('weird:x', 2), ('', 3)), s as (select bin, ord, coalesce(nullif(regexp_replace(bin, '[^A-Za-z0-9_.\-]', '_', 'g'), ''), '_') as s from b),
n as (select bin, ord, s || case when row_number() over (partition by s order by ord) > 1 then '_' || (row_number() over (partition by s order by ord) - 1) else '' end as safe_name from s),
c as (select source as contig, doc_id, unnest([doc_id % 20 % 4, (doc_id % 20 + 1) % 4]) as ord from documents)
select n.safe_name, c.contig, count(*) as n from c join n on c.ord = n.ord group by all""")
def bin_fanout(spark, d):
    bins = safe_names(spark.createDataFrame([("bin 1", 0), ("bin/1", 1), ("weird:x", 2), ("", 3)], "bin string, ord int"))
    reads = _table(spark, d, "documents").select(F.col("source").alias("contig"), F.explode(F.array(F.col("doc_id") % 20 % 4, (F.col("doc_id") % 20 + 1) % 4)).alias("ord"))
    return reads.join(bins, "ord").groupBy("safe_name", "contig").agg(F.count("*").alias("n"))


def _groupings(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.col("doc_id").alias("ord"), "lang", "source")
    code = lambda c: F.substring(F.md5(F.col(c).cast("binary")), 1, 1)
    return docs.where("read_id % 7 != 0").withColumn("label", code("lang")), docs.where("read_id % 5 != 0").withColumn("label", code("source"))


_GROUPS = "with a as (select doc_id as read_id, substr(md5(lang), 1, 1) as label from documents where doc_id % 7 <> 0), b as (select doc_id as read_id, substr(md5(source), 1, 1) as label from documents where doc_id % 5 <> 0)"


@query(_GROUPS + """ select count(*) filter (a.label is not null and b.label is not null) as shared, count(*) filter (b.label is null and a.label is not null) as only_a, count(*) filter (a.label is null and b.label is not null) as only_b,
  count(*) filter (a.label = b.label) as match, count(*) filter (a.label <> b.label) as mismatch from a full join b on a.read_id = b.read_id""")
def pairwise_similarity(spark, d):
    return P.pairwise_similarity(*_groupings(spark, d))


@query(_GROUPS + " select coalesce(a.read_id, b.read_id) as read_id, a.label as a, b.label as b from a full join b on a.read_id = b.read_id")
def merged_assignments(spark, d):
    a, b = _groupings(spark, d)
    return P.merge_assignments({"a": a, "b": b})


@query()
def optimal_label_matching(spark, d):
    return spark.createDataFrame(P.optimal_mapping(*_groupings(spark, d)), "label_a string, label_b string, n long")


@query(f"""with {CALLS}, a as (select read_id, motif, avg(prob::double) as m from calls group by all),
c as (select motif, case when m is null then 'missing' when m >= 0.2 then 'high' else 'low' end as level, count(*) as n from a group by all)
select motif, level, n, round(n / sum(n) over (partition by motif), 6) as fraction from c""")
def contingency_fraction(spark, d):
    a = C.read_aggregate(calls_of(spark, d), ["read_id", "motif"])
    return P.level_fractions(a, 0.2).select("motif", "level", "n", _r("fraction", "fraction"))


@query(f"""with {CALLS}, c as (select contig, (floor(ref_pos / 3000) * 3000)::bigint as chunk, prob::double as p from calls)
select contig, chunk, count(*) as n, {', '.join(f'round(quantile_cont(p, {q}), 6) as q{int(100 * q)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))} from c group by contig, chunk""")
def chunk_quantiles(spark, d):
    q = P.chunk_quantiles(calls_of(spark, d).withColumnRenamed("ref_pos", "ref_position"), 3000)
    return q.select("contig", "chunk", "n", *(_r(f"q{k}", f"q{k}") for k in (10, 25, 50, 75, 90)))


@query(f"""with {CALLS}, a as (select read_id, motif, count(*) as k, avg(prob::double) as m from calls group by all)
select motif, case when k < 5 then '<5' when k <= 10 then '5-10' when k <= 20 then '11-20' else '>20' end as calls, floor(m / 0.05::double)::bigint as bin, count(*) as n from a group by all""")
def histogram(spark, d):
    return P.histogram(C.read_aggregate(calls_of(spark, d), ["read_id", "motif"]))


@query("with n as (select event_type as motif, count(*) as n from events group by 1 order by n desc, motif limit 4) select a.motif as a, b.motif as b from n a join n b on a.motif < b.motif")
def top_motif_pairs(spark, d):
    return P.top_motif_pairs(_table(spark, d, "events").select(F.col("event_type").alias("motif")), 3)


@query("select event_id, printf('%.4f', k / 20000.0::double) as shown from (select event_id, json_extract_string(props, '$.k')::int as k from events)")
def fixed_point_text(spark, d):
    rows = _table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.select("event_id", fixed(F.col("k") / F.lit(20000.0)).alias("shown"))


@query(f"with {CALLS} select date_trunc('hour', ts) as begin, c.contig, c.ref_pos as ref_position, c.motif, count(*) filter ({_HIT}) as meth, count(*) filter (not {_HIT}) as unmeth from calls c join events on c.call_ord = events.event_id group by all")
def stream_site_windows(spark, d):
    """The streaming aggregation, run over the table as a batch."""
    times = _table(spark, d, "events").select(F.col("event_id").alias("call_ord"), F.col("ts"))
    return stream_site_counts(calls_of(spark, d).withColumnRenamed("ref_pos", "ref_position").join(times, "call_ord"), threshold=0.2)
