"""Registered queries of this package: one per operator, and the pipeline.

Each query applies its operator, with production parameters, to its whole
table and derives the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from feedlens.llm import (
    ann_imi,
    conversation,
    decontam,
    html_extract,
    langid,
    line_dedup,
    lm_interp,
    merkle,
    packing,
    simhash,
    substring_dedup,
    toxicity,
    url_gbt,
)
from feedlens.llm.common import fold, read

REGISTRY = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


# --- 3: line dedup ----------------------------------------------------------

LINE_DEDUP_SQL = """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from s),
k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, max(doc_id) as keeper from k where length(key) >= 20
      group by key having count(distinct doc_id) >= 3),
f as (select k.doc_id, k.line, k.pos, coalesce(g.keeper <> k.doc_id, false) as gone from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from f group by doc_id
"""


@query("op3_line_dedup", LINE_DEDUP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    n_lines = F.size(line_dedup.lines(F.col("text"))).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"),
                      F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
                      F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


# --- 9: language ID ---------------------------------------------------------

@query("op9_langid")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


# --- 10: SimHash near-dedup -------------------------------------------------

@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, max_bits=3).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- 5: best-fit packing ----------------------------------------------------

@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# --- 6: benchmark decontamination -------------------------------------------

DECONTAM_SQL = """
with it as (select item_id::varchar as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
            from benchmark where item_id is not null),
iw as (select id, least(len(w), 10) as k, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from it where len(w) > 0),
win as (select distinct id, k, array_to_string(w[p:p + k - 1], ' ') as s from iw),
d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
pos as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win)),
found as (select pos.doc_id, pos.p, pos.k, win.id from pos join win
          on win.k = pos.k and win.s = array_to_string(pos.w[pos.p:pos.p + pos.k - 1], ' ')),
hit as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + k)) as q from found) group by doc_id),
ids as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as s from (select distinct doc_id, id from found) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(hit.n, 0) as n_hit, coalesce(ids.n, 0) as n_items,
       sha256(coalesce(ids.s, '')) as items_sha256, hit.n is not null as contaminated
from d left join hit using (doc_id) left join ids using (doc_id)
"""


@query("op6_decontamination", DECONTAM_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


# --- 4: substring dedup -----------------------------------------------------

SUBSTRING_SQL = """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 33)) as p, w from d where len(w) >= 35),
k as (select doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) as key from p),
again as (select key from k group by key having count(*) > 1),
gone as (select distinct doc_id, unnest(range(p, p + 35)) as q from k semi join again using (key)),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as q from d),
y as (select x.doc_id, x.word, x.q, gone.q is not null as g from x left join gone on x.doc_id = gone.doc_id and x.q = gone.q),
z as (select doc_id, count(*) filter (g) as n, string_agg(word, ' ' order by q) filter (not g) as t from y group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(z.n, 0) as n_removed, sha256(coalesce(z.t, '')) as kept_sha256
from d left join z using (doc_id)
"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=35).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


# --- 7: LM scoring ----------------------------------------------------------

@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, model = lm_interp.fit(read(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return lm_interp.score(counted, model).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 1: nearest neighbours --------------------------------------------------

@query("op1_inverted_multi_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_imi.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


# --- 2: URL filter ----------------------------------------------------------

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_gbt.train(url_gbt.rule_labels(pages, URL_RULES))
    return url_gbt.filter_urls(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


# --- 8: toxicity ------------------------------------------------------------

@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    return model.score(docs, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# --- 11: HTML extraction ----------------------------------------------------

@query("op11_html_extraction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.train(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# --- 12: Merkle manifest ----------------------------------------------------

#: DuckDB has no crc32: the table of the reflected polynomial (column t), and the fold over a text's ASCII codes
CRC_SQL = """
crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) as c from range(256) r(i)))"""


def crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), "
            "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)")


MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle_leaf_sql(text: str) -> str:
    said = [text if c == "text" else f"{c}::varchar" for c in MERKLE_FIELDS]
    return "sha256(concat({}))".format(", ".join(f"case when {x} is null then '-' else concat(strlen({x}), ':', {x}) end" for x in said))


MERKLE_SQL = f"""
with recursive {CRC_SQL},
lf as (select doc_id, lang, {merkle_leaf_sql('text')} as leaf,
       case when doc_id is not null and {crc_sql('doc_id::varchar')} % 3 = 0 then
         {merkle_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as claim from documents, crc_table),
l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from lf),
node(lang, lvl, i, h, n) as (
  select lang, 0, i, leaf, n from l
  union all select lang, lvl + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from node
  where n > 1 group by lang, lvl, i // 8, n),
sub as (select lang, lvl as height, h as subroot, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as langs from node where n = 1),
up(lvl, i, h, n) as (
  select 0, g, subroot, langs from sub
  union all select lvl + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from up where n > 1 group by lvl, i // 8, n),
low as (select l.lang, l.i, k as lvl,
          concat(coalesce(string_agg(node.h, '' order by node.i) filter (node.i < l.i // pow(8, k)::bigint), ''), '|',
                 coalesce(string_agg(node.h, '' order by node.i) filter (node.i > l.i // pow(8, k)::bigint), '')) as sib
        from l join sub on sub.lang is not distinct from l.lang, lateral (select unnest(range(height)) as k) ks
        join node on node.lang is not distinct from l.lang and node.lvl = k and node.i // 8 = l.i // pow(8, k + 1)::bigint
        group by l.lang, l.i, k),
high as (select sub.g, k as lvl,
          concat(coalesce(string_agg(up.h, '' order by up.i) filter (up.i < sub.g // pow(8, k)::bigint), ''), '|',
                 coalesce(string_agg(up.h, '' order by up.i) filter (up.i > sub.g // pow(8, k)::bigint), '')) as sib
        from sub, (select distinct lvl as k from up where n > 1) ks
        join up on up.lvl = k and up.i // 8 = sub.g // pow(8, k + 1)::bigint group by sub.g, k),
lows as (select lang, i, list(sib order by lvl) as s from low group by lang, i),
highs as (select g, list(sib order by lvl) as s from high group by g),
path as (select l.doc_id, l.leaf, l.claim, sub.subroot, (select h from up where n = 1) as root,
                list_concat(coalesce(lows.s, []), coalesce(highs.s, [])) as s
         from l join sub on sub.lang is not distinct from l.lang
         left join lows on lows.lang is not distinct from l.lang and lows.i = l.i left join highs on highs.g = sub.g),
fold as (select *, list_reduce(list_prepend(coalesce(claim, leaf), s),
                lambda a, x: sha256(concat(split_part(x, '|', 1), a, split_part(x, '|', 2)))) as folded_root from path)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(s, ''), '|', '')) as proof_sha256, folded_root,
       folded_root = root as verified from fold
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*MERKLE_FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = merkle.leaf_digest([F.col(c) if c != "text" else F.translate("text", upper, upper.lower()) for c in MERKLE_FIELDS])
    manifest = merkle.build(docs, MERKLE_FIELDS, "doc_id", "lang",
                            F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered))
    return merkle.proofs(manifest).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# --- 13: conversation repair ------------------------------------------------

CONVERSATION_SQL = f"""
with recursive {CRC_SQL},
k as (select conv_id as cid, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
      {crc_sql("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as d from conversations, crc_table),
r as (select cid, turn, case when d = 4 then 'user' else role end as role,
      case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
      unnest(range(case when d = 3 then 2 else 1 end)) as copy from k where d <> 0),
o as (select *, row_number() over (partition by cid order by turn nulls first, role, text, copy) as i from r),
f as (select *, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as bare,
      row_number() over (partition by cid, role, text order by i) > 1 as again,
      lag(left(role, 1)) over (partition by cid order by i) as before from o),
g as (select *, case when bare = '' then 'b' when again then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault from f),
-- states 0 none, 1 system, 2 user, 3 assistant; inserts lead from p to q
ins(p, q, n, said) as (values (0, 0, 0, ''), (0, 2, 1, 'u'), (0, 3, 2, 'ua'), (1, 1, 0, ''), (1, 2, 1, 'u'), (1, 3, 2, 'ua'),
                       (2, 2, 0, ''), (2, 3, 1, 'a'), (3, 3, 0, ''), (3, 2, 1, 'u')),
step(p, q, said, letters, cost, edit, role) as (
  select p, s, said, concat(repeat('I', n), 'K'), 2 * n, 'K', x from ins,
         (values (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) v(f, s, x) where f = q
  union all select p, case when q = 2 then 3 else 2 end, said, concat(repeat('I', n), 'R'), 2 * n + 2, 'R',
         case when q = 2 then 'a' else 'u' end from ins
  union all select p, p, '', 'D', 3, 'D', '' from (values (0), (1), (2), (3)) v(p)),
dp(cid, i, state, cost, audit, lines) as (
  select cid, 0::bigint, 0, 0::bigint, '', []::varchar[] from (select distinct cid from g)
  union all
  select cid, i, state, cost, audit, lines from (
    select dp.cid, g.i, step.q as state, dp.cost + step.cost + case when fault = 't' and edit <> 'D' then 1 else 0 end as cost,
           dp.audit || step.letters as audit,
           list_concat(dp.lines, list_concat(list_transform(string_split(step.said, ''),
               lambda c: case c when 'u' then 'user:' when 'a' then 'assistant:' end),
             [case edit when 'K' then concat(g.role, ':', g.text) when 'R' then concat(case step.role when 'u' then 'user' else 'assistant' end, ':', g.text) end])) as lines
    from dp join g on g.cid is not distinct from dp.cid and g.i = dp.i + 1 join step on step.p = dp.state
    where (edit = 'D' or fault in ('t', '')) and (edit <> 'K' or left(g.role, 1) = step.role)
    qualify row_number() over (partition by dp.cid, g.i, step.q order by
      dp.cost + step.cost + case when fault = 't' and edit <> 'D' then 1 else 0 end, dp.audit || step.letters) = 1)),
t as (select cid, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
      count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
      count(*) filter (before is not null and concat(before, left(role, 1)) not in ('su', 'ua', 'au')) as illegal from g group by cid),
e as (select dp.cid, gaps, blank, duplicate, truncated, illegal, dp.cost + 2 * ins.n as cost, dp.audit || repeat('I', ins.n) as audit,
      list_concat(dp.lines, list_transform(string_split(ins.said, ''), lambda c: case c when 'u' then 'user:' when 'a' then 'assistant:' end)) as lines
      from dp join t on t.cid is not distinct from dp.cid and t.n = dp.i
      join ins on ins.p = dp.state and (ins.q = 3 or (ins.p = 0 and ins.q = 0))
      qualify row_number() over (partition by dp.cid order by dp.cost + 2 * ins.n, dp.audit || repeat('I', ins.n)) = 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit,
       sha256(coalesce(array_to_string(list_filter(lines, lambda x: x is not null), chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join e on e.cid is not distinct from c.conv_id
"""


def damaged(conv: DataFrame) -> DataFrame:
    """The faults of the contract, by a checksum of conversation and turn."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    return (conv.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text")))


@query("op13_conversation_repair", CONVERSATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations")
    found = conversation.transcript_digests(conversation.repair(damaged(conv))).withColumnRenamed("conv_id", "of")
    every = conv.groupBy("conv_id").agg(F.lit(0).alias("none"))
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return out.select("conv_id", *[F.coalesce(c, "none").cast("long").alias(c) for c in conversation.TOTALS],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


# --- the pipeline -----------------------------------------------------------

@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
