"""The operators as queries over the given tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, infill, jaccard, lines, mixing, periodic, quality_net, rules, sharding, simhash, substrings, toxicity, warc
from .shared import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(rf"""
with recursive d as (
  select doc_id, source, len({WORDS})::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'text:' || coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w, sum(source_size) over ()::double as total from s),
fill as (  -- rounds: those above three times their size are fixed there, the rest share what is left
  select source, source_size, w, total, false as fixed, total * w / sum(w) over () as target, 0 as round from w
  union all
  select source, source_size, w, total, fixed2,
         case when fixed2 then 3.0 * source_size
              else w * (total - sum(case when fixed2 then 3.0 * source_size else 0 end) over ()) / sum(case when fixed2 then 0 else w end) over () end, round + 1
  from (select *, fixed or target > 3.0 * source_size as fixed2 from fill) where round < 40),
t as (select source, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from fill where round = 40),
o as (
  select d.doc_id, d.source, d.size, d.h, t.source_size, t.target, t.times, t.target - t.times * t.source_size as rest,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
         sum(d.size) over (partition by d.source, d.h) as tied
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
       (size * (times + case when upto <= rest then 1 when upto - tied <= rest and upto - rest < rest - (upto - tied) then 1 else 0 end))::bigint as taken
from o
""")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query(rf"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
g as (
  select doc_id, text, w, case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else [] end as g,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as l
  from d),
u as (select doc_id, unnest(g) as win, generate_subscripts(g, 1) as i from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from u) where n >= 2),
c as (select doc_id, count(distinct i + k)::bigint as n from r, (select unnest([0, 1, 2]) as k) group by doc_id),
m as (
  select g.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(l) as n_lines,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_capitals
  from g left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or (n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines)
            or word_chars < 2 * n_words or word_chars > 14 * n_words or 10 * n_capitals > 4 * word_chars) as kept
from m
""")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(rules.policy_mask(rules.POLICIES["base"]))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
       case when page_id <> first then first end as refers_to
from d left join f using (payload_digest)
""")
def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(r"""
with l as (select doc_id, generate_subscripts(s, 1) as i, unnest(s) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, c.last is null or k.doc_id = c.last as keep from k left join c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (not keep)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (keep), '')) as kept_sha256
from m group by doc_id
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query(r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win
        from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
occ as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1)::bigint)) as i from d, (select distinct n from win))),
hits as (select distinct doc_id, occ.n, i, item_id from occ join win on occ.win = win.win and occ.n = win.n),
words as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
r as (select doc_id as x, doc_id as y from documents union select r.x, l.y from r join l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) c using (doc_id)
""")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


@query(r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
first as (select h, min(doc_id) as least from win group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join first using (h) where least < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select doc_id, count(*) filter (gone.p is not null)::bigint as n_removed, string_agg(word, ' ' order by p) filter (gone.p is null) as kept
         from words left join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))[0]


@query()
def op8_quality_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")


@query()
def op11_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query(rf"""
with h as (  -- crc32 of the decimal doc_id: each byte is taken in, then shifted out bit by bit
  select doc_id, {WORDS} as w, len({WORDS})::bigint as n,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
           lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) as h
  from documents),
g as (select *, h // 10 as g from h), a as (select *, g % greatest(n, 1) as a from g), p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from p),
t as (select doc_id, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
m as (select x.doc_id, y.i - x.i as q, x.i from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and (y.i - x.i) * 4 <= x.n),
b as (select *, i - row_number() over (partition by doc_id, q order by i) as b from m),
s as (select doc_id, q, min(i) as start, count(*) + q as length from b group by doc_id, q, b having count(*) + q >= greatest(6, 4 * q)),
r as (select doc_id, start::bigint as start, length::bigint as length, min(q)::bigint as period from s group by all),
best as (select * from r qualify row_number() over (partition by doc_id order by length::double / period desc, start, period) = 1),
listed as (select doc_id, count(*)::bigint as n_runs, string_agg(format('{{}},{{}},{{}}' || chr(10), start, length, period), '' order by start, period) as runs from r group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
kept as (select doc_id, string_agg(word, ' ' order by i) filter (gone.i is null) as kept from t left join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.start, best.length, best.period, 1000 * best.length // best.period as exponent_milli,
       sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join best using (doc_id) left join listed using (doc_id) left join kept using (doc_id)
""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    out = periodic.periodic_runs(docs.withColumn("text", periodic.repeating(F.col("doc_id"), F.col("text"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || doc_id::varchar) as s from documents),
h as (select *, len(u)::bigint as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
x as (select *, array_to_string(u[1:i], '') as prefix, array_to_string(u[i + 1:j], '') as middle, array_to_string(u[j + 1:n], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from x
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
