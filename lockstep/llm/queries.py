"""The registered queries of this package and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lockstep.llm import bpe, chat, decontaminate, exact_dedup, jaccard, licenses, line_dedup, pii, prefix_trie, quality, substring, token_align, url_filter
from lockstep.llm.common import read, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return keep


@register("op1_chat_format", r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns as (
  select *, regexp_matches(role || ' ' || text, '[\[<]\\*(/?INST\]|/?s>)') as guarded,
    regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') as safe_role,
    regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') as safe_text from given)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(safe_role) + length(safe_text) + 17)::bigint as formatted_chars,
  count(*) filter (where guarded) as escaped_turns
from turns group by conv_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))))).alias("x"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted.select("x.*"))
    out = chat.read_back(chat.masked_text(chat.format_conversations(turns)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                      F.length("formatted").cast("long").alias("formatted_chars"), "escaped_turns")


@register("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("plain", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS),
        F.sha2(joined("plain"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("plain")).cast("long").alias("n_disguised"))


@register("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, emit_ids=False)


@register("op4_exact_dedup", r"""
with normal as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
grouped as (select body, max(doc_id) as keep_id, count(*) as group_size, sha256(body) as text_sha256 from normal group by body)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from normal join grouped using (body)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


@register("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), window=13, emit_text=False)
    return found.drop("spans")


@register("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs)).select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")


@register("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def _sentence_values() -> str:
    return ", ".join(f"('{i}', '{s}')" for i, s in licenses.SENTENCES)


def _rule_values() -> str:
    # Over ' a b c ': the identifiers in order, anything between.
    return ", ".join(f"('{name}', ' {' (.* )?'.join(order)} ', '{' '.join(against)}')" for name, order, against in licenses.RULES)


@register("op2_license_scan", rf"""
with known(sentence_id, sentence) as (values {_sentence_values()}),
rules(license, pattern, against) as (values {_rule_values()}),
cut as (select doc_id, string_split_regex(text, '[.!?:;]+(?:\s+|$)|\n') as parts from documents where text is not null),
sentences as (select doc_id, unnest(parts) as raw, unnest(range(len(parts))) as pos from cut),
found as (
  select doc_id, ' ' || string_agg(sentence_id, ' ' order by pos) || ' ' as ids, count(*) as n_sentences
  from sentences join known on trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) = sentence group by doc_id),
fired as (
  select distinct doc_id, license from found join rules
    on regexp_matches(ids, pattern) and (against = '' or not contains(ids, ' ' || against || ' ')))
select doc_id, trim(any_value(ids)) as sentence_ids, any_value(n_sentences) as n_sentences,
  coalesce(string_agg(license, ',' order by license), '') as licenses
from found left join fired using (doc_id) group by doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"),
                        F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"))


_HOST = r"nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')), '')"


@register("op9_url_filter", rf"""
with hosts as (select page_id, url, {_HOST} as host, date '2024-01-01' + (page_id * 37 % 730)::int as day from pages),
parts as (select *, string_split(host, '.') as labels from hosts),
domains as (select distinct array_to_string(labels[k:], '.') as domain from (select distinct labels from parts where host is not null), range(1, 8) t(k) where k <= len(labels) - 1),
events as (
  select domain, n, date '2024-01-01' + ('0x' || substr(md5(domain || n), 1, 6))::int % 760 as day,
    ['block', 'off', 'allow', 'block', 'off'][1 + ('0x' || substr(md5(domain || n), 7, 4))::int % 5] as action
  from domains, range(4) s(n) where ('0x' || substr(md5(domain), 1, 4))::int % 3 = 0),
daily as (select domain, day, arg_min(action, case action when 'block' then 0 when 'allow' then 1 else 2 end) as action from events group by 1, 2),
intervals as (select domain, action, day as from_day, coalesce(lead(day) over (partition by domain order by day), date '2149-06-07') as to_day from daily),
hits as (
  select page_id, i.domain, i.action from (select page_id, day, unnest([array_to_string(labels[k:], '.') for k in range(1, len(labels) + 1)]) as domain from parts) c
  join intervals i on c.domain = i.domain and c.day >= i.from_day and c.day < i.to_day and i.action <> 'off'),
best as (select page_id, arg_max(domain, length(domain)) as matched_domain, arg_max(action, length(domain)) as matched_action from hits group by page_id)
select page_id, host, matched_domain, matched_action, coalesce(matched_action, 'allow') <> 'block' as allowed
from hosts left join best using (page_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables hold no lists and no fetch times: both are derived from the pages' own hosts and ids."""
    start = F.lit("2024-01-01").cast("date")
    pages = read(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", F.date_add(start, (F.col("page_id") * 37 % 730).cast("int")).cast("timestamp"))
    number = lambda text, at, n: F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("int")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select(F.explode(url_filter.domains_of(F.col("host"))).alias("domain")).where("instr(domain, '.') > 0").distinct()
    events = domains.where(number(F.col("domain"), 1, 4) % 3 == 0).select("domain", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    key = F.concat("domain", F.col("n").cast("string"))
    actions = F.array(*map(F.lit, ("block", "off", "allow", "block", "off")))
    entries = events.select("domain", F.date_add(start, number(key, 1, 6) % 760).alias("listed_on"), F.get(actions, number(key, 7, 4) % 5).alias("action"))
    return url_filter.filter_urls(pages, entries).select("page_id", "host", "matched_domain", "matched_action", "allowed")


@register("op11_line_dedup", r"""
with lines as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (
  select key, max(doc_id) as holder from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
told as (select k.*, c.key is not null and k.doc_id <> c.holder as gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from told group by doc_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=40, least_docs=5, emit_text=False)
    return found.drop("keep_bitmap")


@register("op12_token_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.token_alignment(read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, PIECE_BPE, emit_groups=False)


@register("op13_prefix_trie", r"""
with told as (
  select conv_id, list({'said': length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''), 'size': length(coalesce(text, ''))}
                       order by turn nulls first, role, text) as turns
  from conversations where conv_id is not null group by conv_id),
heads as (
  select *, (xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
                             lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))),
                 4294967295) % 6)::int as h from told),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) as turns
  from heads c left join told b on b.conv_id = c.conv_id - c.conv_id % 100),
members as (select conv_id, len(turns) as n, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
nodes as (
  select turns[:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(turns[depth].size), 0) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from members group by 1, 2),
children as (select path[:depth - 1] as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2),
counted as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on n.path = c.path and n.depth = c.depth),
shares as (select path, unnest(range(depth + 1)) as depth, (n_children = 0)::int as leaf, (n_convs - 1) * size as saved from counted),
subtrees as (select path[:depth] as path, depth, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from shares group by 1, 2)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from counted n join subtrees s on n.path = s.path and n.depth = s.depth left join nodes p on p.path = n.path[:n.depth - 1] and p.depth = n.depth - 1""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(prefix_trie.turn_paths(read(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(own))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
