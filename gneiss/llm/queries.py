"""The queries of this subpackage: thin projections of the operators onto their digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.llm.licenses import template_rows

#: File names of the public tokenizers the queries use.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.sentencepieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE), full=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.line_runs import dedup_digest

    return dedup_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), cleaned=False)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.mixing import in_training_order, mixing_plan

    plan = in_training_order(mixing_plan(table(spark, sf_dir, "documents")), copies=False)
    copies = (F.col("passes") + (F.col("extra") > 0).cast("long")).alias("copies")
    return plan.select("doc_id", "size", "source_size", "target", "taken", copies, F.round("position", 6).alias("position"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.pii import personal_data_digest

    return personal_data_digest(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.whitening import whitened_digest

    return whitened_digest(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.suffix_dedup import dedup_strings

    return dedup_strings(table(spark, sf_dir, "documents"), kept=False).drop("kept_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_nearest_neighbours, op3_source_mixing, op4_token_files, op5_sentencepiece, op6_line_dedup, op7_quality_rules, op8_license_scan, op9_personal_data, op10_html_text, op11_embedding_whitening, op12_importance_resampling, op13_suffix_dedup)
}

_GRAMS = ", ".join(f"({t}, '{label}', {exact}, {n}, {p}, '{' '.join(w)}')" for t, label, exact, n, p, w in template_rows())
_PHRASES = "all rights reserved|accept cookies|cookie policy|enable javascript|javascript is disabled|lorem ipsum|privacy policy|read more|sign up for our newsletter|terms of service|terms of use|use of cookies"
ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": """
with s as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
           md5(coalesce(cast(doc_id as varchar), '')) as h
    from documents
), sources as (
    select source, sum(size)::bigint as source_size,
           [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as w
    from s group by source
), ordered as (
    select *, row_number() over by_cap as k, sum(source_size) over () as everything,
           coalesce(sum(3 * source_size) over (by_cap rows between unbounded preceding and 1 preceding), 0) as capped,
           sum(w) over (by_cap rows between current row and unbounded following) as w_left
    from sources window by_cap as (order by 3.0 * source_size / w, source nulls last)
), level as (
    select coalesce(min_by((everything - capped) / w_left::double, k), 1e300) as x
    from ordered where w * ((everything - capped) / w_left::double) <= 3 * source_size
), aimed as (
    select source, source_size, w, least(w * x, (3 * source_size)::double) as target from sources, level
), quotas as (
    select *, round(target)::bigint as quota, case when source_size > 0 then round(target)::bigint // source_size else 0 end as passes from aimed
), placed as (
    select s.doc_id, s.size, q.*, coalesce(sum(size) over (partition by s.source order by h, size rows between unbounded preceding and 1 preceding), 0) as before
    from s join quotas q on s.source is not distinct from q.source
), shares as (
    select *, coalesce(before / nullif(target, 0), 0.0)::double as x, greatest(least(quota - passes * source_size - before, size), 0) as extra from placed
)
select doc_id, size::bigint as size, source_size, target, (passes * size + extra)::bigint as taken, (passes + (extra > 0)::int)::bigint as copies,
       round(case w when 5 then least(2 * x / (sqrt(greatest(2.25 - 2 * x, 0)::double) + 1.5), 1.0) when 2 then least(x, 1.0)
                    when 1 then case when x < 0.375 then least(2 * x / (sqrt(0.25::double + 2 * x) + 0.5), 0.5) else least(0.5 + 2 * (x - 0.375) / (sqrt(1.0::double + 2 * (x - 0.375)) + 1.0), 1.0) end end, 6) as position
from shares
""",
    "op7_quality_rules": f"""
with w as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), triples as (
    select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as t from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)
), places as (
    select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, t) as c from triples) where c > 1
), repeats as (
    select doc_id, count(distinct p) as n_repeat_words from places group by 1
), lines as (
    select doc_id, generate_subscripts(l, 1) as j, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from w)
), own as (
    select *, row_number() over (partition by doc_id, line order by j) as copy
    from (select *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as lw from lines) where len(lw) > 0
), most as (
    select doc_id, j, max(c) as top from (select doc_id, j, x, count(*) as c from (select doc_id, j, unnest(lw) as x from own) group by all) group by 1, 2
), judged as (
    select o.doc_id, copy, len(lw) as n, case
        when len(lw) <= 30 and regexp_matches(lower(line), '{_PHRASES}') then true
        when len(lw) < 6 then false
        when len(list_filter(lw, lambda x: x in ('|', '>', '»', '›', '·', '•'))) > 0.2 * len(lw) then true
        when len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 0.3 * len(lw) then true
        when len(regexp_extract_all(line, '[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]')) > len(lw)
         and len(regexp_extract_all(line, '[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]')) > 0.6 * len(regexp_extract_all(line, '[\\pL\\p{{No}}\\p{{Nl}}]')) then true
        when top > greatest(0.3 * len(lw), 6) then true
        else not regexp_matches(line, '[.,;:!?…。！？،؛।]') end as fails
    from own o join most m on m.doc_id = o.doc_id and m.j = o.j
), losses as (
    select doc_id, count(*) filter (copy > 1) as n_dup_lines, coalesce(sum(n) filter (fails), 0) as lost from judged group by 1
), counts as (
    select w.doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
           coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost
    from w left join losses using (doc_id) left join repeats using (doc_id)
), failed as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= 0.3 * n_words as kept from failed
""",
    "op8_license_scan": f"""
with t as (select * from (values {_GRAMS}) v(tid, label, exact, grams, tpos, gram)
), w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
), g as (
    select doc_id, i - 1 as pos, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)
), votes as (
    select doc_id, tid, any_value(label) as label, any_value(exact) as exact, any_value(grams) as grams, pos - tpos as diagonal, list(distinct tpos) as seen
    from g join t using (gram) group by doc_id, tid, pos - tpos
), marked as (
    select *, (coalesce(diagonal - lag(diagonal) over (partition by doc_id, tid order by diagonal), 0) > 3)::int as apart from votes
), spanned as (
    select *, sum(apart) over (partition by doc_id, tid order by diagonal) as span, exact and len(seen) = grams as whole from marked
), spans as (
    select doc_id, tid, any_value(label) as label, any_value(exact) as exact, any_value(grams) as grams, len(list_distinct(flatten(list(seen)))) as covered,
           count(*) filter (whole) as places, min(diagonal) filter (whole) as first, max(diagonal) filter (whole) as last from spanned group by doc_id, tid, span
), shares as (
    select *, case when exact then (places > 0)::int::double else covered / grams::double end as share from spans
), found as (
    select doc_id, sum(places)::bigint as n_base, min(first)::bigint as first_word, max(last)::bigint as last_word,
           array_to_string(list_sort(list(distinct label) filter (places > 0)), ',') as base_labels,
           array_to_string(list_sort(list(distinct label) filter (share >= 0.6)), ',') as labels, max(share) as score from shares group by 1
)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6) as score from w left join found using (doc_id)
""",
    "op12_importance_resampling": """
with recursive crc as (
    select i, i::bigint as c, 0 as k from range(256) r(i)
    union all
    select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8
), steps as (
    select list(c order by i) as step from crc where k = 8
), d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words,
           row_number() over () as own
    from documents
), b as (
    select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from benchmark
), used as (
    select own, unnest(words) as w from d
), seen as (
    select w, hex(encode(w)) as digits from (select distinct w from used union select distinct w from b)
), hashed as (
    select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(digits) // 2),
                  lambda i: 16 * (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1)::bigint + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
                  lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
    from seen, steps
), source as (
    select bucket, count(*) as s from used join hashed using (w) group by 1
), aim as (
    select bucket, count(*) as t from b join hashed using (w) group by 1
), totals as (
    select (select count(*) from used) as ss, (select count(*) from b) as tt
), gains as (
    select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + 10000) / ((coalesce(s, 0) + 1)::double * (tt + 10000))))::bigint as gain
    from source full join aim using (bucket), totals
), weights as (
    select own, sum(gain)::bigint as weight from used join hashed using (w) join gains using (bucket) group by 1
), scored as (
    select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from d left join weights using (own)
), ranked as (
    select *, row_number() over (order by n_features >= 20 desc, score desc, doc_id nulls last) as k, count(*) filter (n_features >= 20) over () as n from scored
)
select doc_id, n_features, weight, score, case when k <= 10 * n // 100 then k end as rank from ranked
""",
}
