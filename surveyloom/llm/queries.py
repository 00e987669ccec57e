"""Registered queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import (conversations, decontaminate, exact_dedup, hard_negatives, html_text, language_model, line_dedup, mixing, near_dedup,
                            packing, quality, secrets, toxicity)
from surveyloom.llm.common import remainder
from surveyloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        ENTRIES[run.__name__] = Entry(run, sql)
        return run
    return register


def id_digest(ids) -> F.Column:
    return F.sha2(F.array_join(ids, ","), 256)


EXACT_SQL = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from (select doc_id, sha256(coalesce(text, '')) as text_sha256,
             max(doc_id) over same as keep_id, count(*) over same as group_size
      from documents window same as (partition by coalesce(text, '')))
"""


@query(EXACT_SQL)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read_table(spark, folder, "documents"))
    return groups.withColumnRenamed("id", "doc_id")


DECONTAMINATION_SQL = """
with words as (
  select doc_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (
  select distinct item, unnest(case when len(w) < 13 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) end) as win,
    least(len(w), 13) as width
  from items where len(w) > 0),
places as (
  select doc_id, width, unnest(range(1, len(w) - width + 2)) as pos, w
  from words, (select distinct width from windows) where len(w) >= width),
spelled as (select doc_id, width, pos, array_to_string(w[pos:pos + width - 1], ' ') as win from places),
hits as (select doc_id, pos, s.width, item from spelled s join windows using (win) where s.width = windows.width),
covered as (select doc_id, count(distinct p) as n_hit
            from (select doc_id, unnest(range(pos, pos + width)) as p from (select distinct doc_id, pos, width from hits))
            group by doc_id),
named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids
          from hits group by doc_id)
select words.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join covered using (doc_id) left join named using (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                        id_digest(F.col("items")).alias("items_sha256"), "contaminated")


@query()
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.ADDED)
    return found.select(
        F.col("id").alias("doc_id"),
        *[secrets.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(read_table(spark, folder, "documents"), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


NEAR_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n
           from sets x join sets y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b
          where 100 * common.n >= 75 * (p.n + q.n - common.n)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from words union select reach.doc_id, b from reach join edges on a = other),
least_ids as (select doc_id, min(other) as component_id from reach group by doc_id)
select words.doc_id, coalesce(n, 0) as n_shingles, component_id, words.doc_id = component_id as kept
from words left join sizes using (doc_id) join least_ids using (doc_id)
"""


@query(NEAR_SQL)
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_dedup.near_groups(read_table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query()
def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.scores(read_table(spark, folder, "documents"), remainder("doc_id", 7) == 2)
    return scored.withColumnRenamed("id", "doc_id")


@query()
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read_table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def quality_model(spark: SparkSession, docs: DataFrame, folder: str):
    """Labels of a remainder of 2 are never learned from."""
    return quality.fit(docs, read_table(spark, folder, "labels"), remainder("doc_id", 4) != 2)


@query()
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = quality.quality_scores(docs, quality_model(spark, docs, folder)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 0
    docs = read_table(spark, folder, "documents")
    network = toxicity.fit(docs, read_table(spark, folder, "labels"), ~held_out)
    found = toxicity.toxicity_scores(docs, network).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SITE_LINES_SQL = f"""
with rows as (
  select page_id, nullif(translate(regexp_extract(url, '{line_dedup.HOST}', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{line_dedup.NO_TEXT}', chr(10), 'g'), '{line_dedup.LINE_END}', chr(10), 'g'), '{line_dedup.MARKUP}', '', 'g'), chr(10)),
      lambda x: trim(regexp_replace(x, '{line_dedup.SPACE}', ' ', 'g'))), lambda x: x <> '') as lines from pages),
totals as (select host, count(*) as total from rows where host is not null group by host),
counted as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from rows) group by all),
often as (select host, list(line) as boiler from counted join totals using (host)
          where n >= {line_dedup.LEAST_PAGES} and n > {line_dedup.RATIO} * total group by host),
kept as (select page_id, rows.host, lines, list_filter(lines, lambda x: not list_contains(coalesce(boiler, []), x)) as k
         from rows left join often on rows.host = often.host)
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(k))::bigint as n_dropped,
  coalesce(array_to_string(k, chr(10)), '') as text from kept
"""


@query(SITE_LINES_SQL)
def op8_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    found = line_dedup.without_boilerplate(pages, line_dedup.html_column("html"))
    return found.withColumnRenamed("id", "page_id")


MIXING_SQL = f"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::bigint as size,
    cast(('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), ''), ':', coalesce(text, ''))), 1, 15)) as bigint) as h
  from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from rows group by source),
weighed as (select source, source_size,
    [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight from sources),
steps as (select 2 * source_size / weight as fullness, sum(2 * source_size) as bound, sum(weight) as weight from weighed group by all),
run as (select sum(bound) over () / 2 * 150 as budget, sum(bound) over upto - bound as filled,
    sum(weight) over () - sum(weight) over upto + weight as open_weight
  from steps window upto as (order by fullness rows unbounded preceding)),
level as (select max((budget - 100 * filled) / (100 * open_weight)) as level from run),
targets as (select source, source_size, least(cast(2 * source_size as double), weight * level) as target from weighed, level),
wanted as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as times,
    target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as open from targets),
placed as (select doc_id, size, source_size, target, times, open,
    sum(size) over (partition by r.source order by h rows unbounded preceding) as run
  from rows r join wanted w on r.source is not distinct from w.source)
select doc_id, size, source_size, target, cast((times + case when run <= open or (run - size <= open
    and 2 * (open - run + size) >= size) then 1 else 0 end) * size as bigint) as taken
from placed
"""


@query(MIXING_SQL)
def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The repair of damaged conversations; those of which the damage left no row have zeros."""
    talks = read_table(spark, folder, "conversations")
    repair = conversations.Repair(conversations.damaged(talks))
    ids = talks.groupBy("conv_id").agg(F.lit(0).alias("none")).select("conv_id")
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = ids.join(repair.summary(), same, "left").drop("conv").join(repair.digests(), same, "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


NEGATIVES_SQL = """
with ok as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from ok a join ok b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
good as (select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
hard as (
  select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank
  from good p join scored n on n.anchor_id = p.anchor_id and not n.same
    and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from hard where rank <= 5
"""


@query(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.usable(read_table(spark, folder, "embeddings"), "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), hard_negatives.whole_numbers(F.col("embedding")).alias("embedding"))
    return hard_negatives.mine(whole, F.col("vec_id") % 100 == 0)
