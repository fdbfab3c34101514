"""The operators over their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    crc,
    exact_dedup,
    importance,
    jaccard,
    language_id,
    lexical_search,
    lm_scoring,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    warc,
)
from recordloom.llm.ship import ship


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*names, "failed_rules")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_pieces(_table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(_table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_mixing,
        op3_substring_dedup,
        op4_quality_rules,
        op5_simhash,
        op6_packing,
        op7_sharding,
        op8_warc,
        op9_lm_scoring,
        op10_language_id,
        op11_lexical_search,
        op12_ngram_jaccard_join,
        op13_importance_resampling,
    )
}

_BASE32 = f"""array_to_string(list_transform(range(32), lambda k: substr('{warc.BASE32}',
  (((('0x' || substr(sha1(payload), 5 * (k // 4) + 1, 5))::int) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '')"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms(text: str) -> str:
    return rf"regexp_extract_all({_LOWER.format(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _runs(table: str) -> str:
    """(doc, feature): the runs of 1 to 3 of the words of a table (doc, words), joined by a space."""
    return f"""select doc, unnest([x, x || ' ' || y, x || ' ' || y || ' ' || z]) as feature from (
    select doc, x, lead(x) over w as y, lead(x, 2) over w as z from (
      select doc, unnest(words) as x, generate_subscripts(words, 1) as place from {table})
    window w as (partition by doc order by place))"""


_BUCKETS = importance.BUCKETS

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256 from n join g using (t)""",
    "op2_mixing": r"""with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix/' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as spread from documents),
sources as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from docs group by source),
rounds as (
  select 0 as n, 0::double as level, -1::bigint as held
  union all
  select n + 1, (total - 3 * held_size) / free, held_rows from (
    select r.n, r.held, (select sum(source_size) from sources)::bigint as total,
      (select coalesce(sum(source_size), 0) from sources where source_size * 3 < weight * r.level)::bigint as held_size,
      (select count(*) from sources where source_size * 3 < weight * r.level) as held_rows,
      (select sum(weight) from sources where not source_size * 3 < weight * r.level) as free
    from rounds r)
  where held_rows <> held and free > 0),
targets as (
  select source, source_size, case when source_size * 3 < weight * level then source_size::double * 3 else weight * level end as target
  from sources cross join (select level from rounds order by n desc limit 1)),
queue as (
  select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by spread, doc_id nulls first, size rows unbounded preceding)::bigint as queued
  from docs d join targets t on d.source is not distinct from t.source),
units as (
  select *, (pass * source_size + queued) / target as finish from queue cross join (values (0), (1), (2)) p(pass)
  where size > 0 and pass * source_size + queued - size < target),
spent as (
  select *, sum(size) over (order by finish, source nulls first, spread, doc_id nulls first, pass, size rows unbounded preceding) as spent from units),
counted as (
  select doc_id, source, count(*) as passes from spent where spent <= (select sum(size) from docs) group by doc_id, source)
select q.doc_id, size, source_size, target, (size * coalesce(passes, 0))::bigint as taken
from queue q left join counted c on q.doc_id is not distinct from c.doc_id and q.source is not distinct from c.source""",
    "op8_warc": f"""with p as (select page_id, coalesce(html, '') as payload from pages),
g as (select payload, max(page_id) as first from p group by payload)
select page_id, strlen(payload) as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p join g using (payload)""",
    "op11_lexical_search": f"""with d as (
  select row_number() over () as doc, doc_id, {_terms("text")} as terms from documents),
n as (select doc, doc_id, len(terms)::bigint as n from d),
total as (select count(*) filter (n > 0) as documents, coalesce(sum(n), 0)::bigint as occurrences from n),
i as (select row_number() over () as item, item_id, list_distinct({_terms("text")}) as terms from benchmark),
asked as (select item, item_id, unnest(terms) as term from i),
held as (
  select doc, term, count(*) as tf from (select doc, unnest(terms) as term from d) where term in (select term from asked) group by doc, term),
weights as (
  select term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::bigint as w from held cross join total group by term, documents),
scores as (
  select item, item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // occurrences))))::bigint as score
  from asked join weights using (term) join held using (term) join n using (doc) cross join total group by item, item_id, doc_id, doc),
ranked as (
  select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {lexical_search.BEST}""",
    "op12_ngram_jaccard_join": rf"""with recursive d as (
  select row_number() over () as doc, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') as words from documents),
runs as (
  select doc, x || ' ' || lead(x) over w || ' ' || lead(x, 2) over w as shingle from (
    select doc, unnest(words) as x, generate_subscripts(words, 1) as place from d)
  window w as (partition by doc order by place)),
s as materialized (
  select distinct doc, shingle from runs where shingle is not null
  union all
  select doc, array_to_string(words, ' ') from d where len(words) between 1 and {jaccard.SHINGLE - 1}),
n as (select doc, count(*) as n from s group by doc),
links as materialized (
  select a, b from (
    select x.doc as a, y.doc as b, count(*) as common from s x join s y on x.shingle = y.shingle and x.doc <> y.doc group by x.doc, y.doc)
  join n p on p.doc = a join n q on q.doc = b where 100 * common >= {jaccard.PERCENT} * (p.n + q.n - common)),
reached as (
  select doc, doc as other from n
  union
  select r.doc, l.b from reached r join links l on r.other = l.a),
least as (select r.doc, min(d.doc_id) as least from reached r join d on d.doc = r.other group by r.doc)
select doc_id, coalesce(n, 0) as n_shingles, case when n is null then doc_id else least end as component_id
from d left join n using (doc) left join least using (doc)""",
    "op13_importance_resampling": f"""with recursive steps as (
  select 0 as k, b, b as c from (select unnest(range(256)) as b)
  union all
  select k + 1, b, case when c & 1 = 1 then xor(c >> 1, {crc.POLYNOMIAL}) else c >> 1 end from steps where k < 8),
sums as (select list(c order by b) as of_byte from steps where k = 8),
d as (select row_number() over () as doc, doc_id, {_terms("text")} as words from documents),
b as (select row_number() over () as doc, {_terms("text")} as words from benchmark),
features as materialized (select * from ({_runs("d")}) where feature is not null),
wanted as materialized (select * from ({_runs("b")}) where feature is not null),
known as (select feature, hex(feature) as digits from (select feature from features union select feature from wanted)),
bytes as (
  select feature, len(digits) // 2 as length, unnest(range(0, len(digits) // 2)) as place, digits from known),
longest as (select coalesce(max(len(digits) // 2), 0) as bytes from known),
moved as (
  select 0 as far, b, c from steps where k = 8
  union all
  select far + 1, b, xor(c >> 8, of_byte[(c & 255) + 1]) from moved cross join sums where far < (select bytes from longest)),
begun as (
  select 0 as far, 4294967295 as c
  union all
  select far + 1, xor(c >> 8, of_byte[(c & 255) + 1]) from begun cross join sums where far < (select bytes from longest)),
raw as (
  select feature, length, bit_xor(c) as c
  from bytes join moved on far = length - 1 - place and b = ('0x' || substr(digits, 2 * place + 1, 2))::bigint group by feature, length),
hashed as (select feature, xor(xor(raw.c, begun.c), 4294967295) % {_BUCKETS} as bucket from raw join begun on far = length),
counts as (select bucket, count(*) as n from features join hashed using (feature) group by bucket),
target as (select bucket, count(*) as n from wanted join hashed using (feature) group by bucket),
totals as (select (select count(*) from features) as s_all, (select count(*) from wanted) as t_all),
gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + {_BUCKETS}) / ((c.n + 1) * (t_all + {_BUCKETS}))))::bigint as gain
  from counts c left join target t using (bucket) cross join totals),
weights as (
  select doc, count(*) as n_features, sum(gain)::bigint as weight from features join hashed using (feature) join gains using (bucket) group by doc),
scored as (
  select doc, doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join weights using (doc)),
ranked as (
  select doc, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from scored where n_words >= {importance.MIN_WORDS})
select doc_id, n_features, weight, score, rank from scored left join (
  select doc, rank from ranked where rank <= ({importance.PERCENT} * n) // 100) using (doc)""",
}
