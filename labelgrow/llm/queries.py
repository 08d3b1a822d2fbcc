"""The registered queries of the pipeline operations; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode, n_ids
from .chat_format import format_chats, read_chats
from .decontaminate import find_leaks
from .jaccard_join import link_components
from .langid import fit, held_out, identify
from .line_dedup import dedup_lines
from .minhash import fingerprint_groups
from .pii import KINDS, find_personal_data, span_text
from .prefix_trie import numbered_turns, prefix_trie, share_heads
from .shared import new_path, stored
from .substring_dedup import repeated_passages, repeated_runs
from .url_filter import judge_urls
from .warc import convert, mark_revisits, page_responses, read_arc, read_warc, write_arc, write_warc
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    done = identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = repeated_passages(_table(spark, sf_dir, "documents"), unit="sentence", min_words=30)
    return gone.select("doc_id", "unit", "start", "end", "n_words", "passage_words", "kept_doc_id", "kept_unit", "kept_start", "kept_end")


def op2_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    longest = F.array_max(F.transform("m.tiles", lambda x: x["length"]))
    return found.select("doc_id", "m.item_id", "m.coverage", "m.n_tokens", F.size("m.tiles").alias("n_tiles"), longest.alias("longest_tile"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, bytes_col="decoded")
    return done.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    per_file = write_arc(page_responses(_table(spark, sf_dir, "pages")), arc)
    legacy = read_arc(spark, arc)
    write_warc(mark_revisits(convert(legacy), convert(legacy, with_block=False)), warc, per_file)
    records = read_warc(spark, warc, with_block=False).filter(F.col("warc_type") != "warcinfo")
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_key").alias("refers_to")
    )


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_components(docs).select("doc_id", "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: lambda x: x["kind"] == kind
    spans, keys = F.concat("base", F.filter("found", lambda x: x["kind"] != "key")), F.filter("found", of("key"))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
        span_text(keys).alias("keys"),
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_groups(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    return done.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered_turns(_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*share_heads(turns))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    done = read_chats(stored(format_chats(chats), "chats"))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", F.col("problem").isNull().alias("in_order"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op2_repeated_runs, op3_decontaminate, op4_byte_bpe, op5_arc_to_warc, op6_url_templates, op7_jaccard_join, op8_line_dedup, op9_personal_data, op10_minhash, op11_whitening, op12_prefix_trie, op13_chat_format)}


#: DuckDB has ``lower`` for all letters only, so A-Z go through ``translate``.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": """
            with t as (select doc_id, string_split(regexp_replace(text, '([^.!?][.!?])[ \\t]', '\\1' || chr(10), 'g'), chr(10)) as lines from documents),
            u as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from t),
            l as (select doc_id, line, (sum(length(line) + 1) over (partition by doc_id order by i) - 1)::bigint as "end" from u),
            w as (
                select doc_id, "end" - length(line) as start, "end", len(string_split(k, ' ')) as n_words, k,
                       row_number() over (partition by doc_id order by "end") - 1 as unit
                from (select *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) as k from l) where k <> ''),
            r as (
                select *, first(doc_id) over f as kept_doc_id, first(unit) over f as kept_unit, first(start) over f as kept_start,
                       first("end") over f as kept_end
                from w window f as (partition by k order by doc_id, unit)),
            g as (
                select *, unit - row_number() over (partition by doc_id order by unit) as run from r
                where kept_doc_id <> doc_id or kept_unit <> unit),
            p as (select *, sum(n_words) over (partition by doc_id, run)::bigint as passage_words from g)
            select doc_id, unit::int as unit, start::int as start, "end"::int as "end", n_words::int as n_words, passage_words,
                   kept_doc_id, kept_unit::int as kept_unit, kept_start::int as kept_start, kept_end::int as kept_end
            from p where passage_words >= 30""",
        "op5_arc_to_warc": """
            with p as (
                select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
            f as (select payload_digest, min(page_id) as f from p where payload_bytes >= 100 group by payload_digest)
            select p.*, case when f.f < p.page_id then 'revisit' else 'response' end as record_type, case when f.f < p.page_id then f.f end as refers_to
            from p left join f on p.payload_digest = f.payload_digest""",
        "op8_line_dedup": f"""
            with l as (
                select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
                from documents),
            k as (select doc_id, pos, line, trim(translate(line, {_AZ}), {_BLANKS}) as k from l),
            d as (select k, max(doc_id) as keeper from k where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
            m as (select k.*, d.keeper is not null and k.doc_id < d.keeper as lost from k left join d on k.k = d.k)
            select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
            from m group by doc_id""",
        "op12_prefix_trie": """
            with crc as (
                select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as tbl),
            own as (
                select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                       row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos
                from conversations where conv_id is not null),
            listed as (select conv_id, list({'role': role, 'text': text} order by pos) as turns from own group by conv_id),
            c as (
                select conv_id, turns, conv_id - conv_id % 5 as base,
                       xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                                       lambda s, b: xor(s >> 8, tbl[1 + (xor(s, b) & 255)])), 4294967295) % 9 as h
                from listed, crc),
            r as (
                select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
                from c left join listed b on b.conv_id = c.base),
            p as (
                select conv_id, len(turns) as length, unnest(range(0, len(turns) + 1)) as depth, turns from r),
            k as (select conv_id, length, depth, sha256(to_json(turns[1:depth])::varchar) as node, sha256(to_json(turns[1:depth - 1])::varchar) as up,
                         case when depth > 0 then strlen(turns[depth].text) else 0 end as n_bytes from p),
            n as (
                select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(up) as up, any_value(n_bytes) as n_bytes,
                       sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where length = depth), '')) as ends_sha256
                from k group by node, depth),
            kids as (select up, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
            f as (select n.*, coalesce(n_children, 0) as n_children from n left join kids on kids.up = n.node and kids.depth = n.depth),
            below as (
                select a.node, a.depth, sum(case when d.n_children = 0 then 1 else 0 end)::bigint as n_leaves,
                       sum((d.n_convs - 1) * d.n_bytes)::bigint as saved_tokens
                from f d join k on k.conv_id = d.conv_id and k.depth <= d.depth join f a on a.node = k.node and a.depth = k.depth
                group by a.node, a.depth)
            select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
            from f join below using (node, depth) left join f u on f.depth > 0 and u.node = f.up and u.depth = f.depth - 1""",
        "op13_chat_format": """
            with t as (
                select conv_id, turn, role, text from conversations
                union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
                       regexp_replace(regexp_replace(coalesce(text, ''), '<(\\\\*/?s>)', '<\\\\\\1', 'g'),
                                      '\\[(\\\\*(/?(SYS|INST)\\]|ROLE|/ROLE\\]))', '[\\\\\\1', 'g') as escaped
                from t),
            o as (
                select *, row_number() over w as pos, lag(role) over w as before, count(*) over (partition by conv_id) as n
                from e window w as (partition by conv_id order by turn nulls first, role, text)),
            m as (
                select *, case role when 'system' then 13 when 'user' then 15 when 'assistant' then 4 else 16 + length(url_encode(role)) end as marks,
                       (pos = 1 and role in ('system', 'user') or before = 'system' and role = 'user' or before = 'user' and role = 'assistant'
                           or before = 'assistant' and role = 'user') and (pos < n or role = 'assistant') as fits
                from o)
            select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
                   coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
                   sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
                   (3 + sum(marks + length(escaped)))::bigint as formatted_chars, bool_and(coalesce(fits, false)) as in_order
            from m group by conv_id""",
    }
