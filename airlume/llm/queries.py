"""Queries of the operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlume.llm import (
    audit,
    bpe,
    decontaminate,
    exact,
    lines,
    phrases,
    quality,
    rules,
    secretscan,
    simhash,
    substrings,
    tokencounts,
    urls,
)
from airlume.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


_OP3_SQL = r"""
with n as (
    select doc_id, coalesce(text, '') as t,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
    from documents
), g as (
    select doc_id, norm,
           first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id,
           count(*) over (partition by norm) as group_size
    from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""


@query("op3_exact_dedup", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


_OP4_SQL = r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), i as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), iw as (
    select distinct item_id, least(len(w), 13) as n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from i where len(w) > 0)
), sizes as (
    select distinct n from iw
), dw as (
    select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)
), hits as (
    select doc_id, item_id, p, n from dw join iw using (n, win)
), covered as (
    select doc_id, count(distinct q) as n_hit
    from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
    from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(list, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""


@query("op4_benchmark_decontamination", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_OP10_SQL = r"""
with d as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
    select doc_id, p, array_to_string(w[p:p + 12], ' ') as t
    from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from d where len(w) >= 13)
), first as (
    select t, min(doc_id) as first_id from win group by t having count(distinct doc_id) > 1
), gone as (
    select distinct doc_id, unnest(range(p, p + 13)) as q from win join first using (t) where doc_id > first_id
), words as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as q from d
), kept as (
    select doc_id, string_agg(word, ' ' order by q) as t, count(*) as n
    from words anti join gone using (doc_id, q) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.decimal_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


# The rules every url is judged by.
RULES = [
    urls.Rule("com", "/", True),
    urls.Rule("example.com", "/en/", False),
    urls.Rule("www.example.com", "/en/", True),
    urls.Rule("net", "/es/", False),
    urls.Rule("net", "/fr/", False),
]


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secretscan.listed(base), 256).alias("base_sha256"),
        secretscan.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP9_SQL = r"""
with l as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as ln
    from documents
), n as (
    select *, row_number() over (partition by doc_id order by ln) as place, count(*) over (partition by doc_id) as of,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as nw
    from l where regexp_matches(line, '[^\x20\x09-\x0D]')
), w as (
    select doc_id, place, of, s, lines[1:s] as run, list_sum(words[1:s]) as total
    from (
        select doc_id, place, of, [line, lead(line) over r, lead(line, 2) over r] as lines,
               [nw, lead(nw) over r, lead(nw, 2) over r] as words
        from n window r as (partition by doc_id order by ln)
    ), (select unnest([1, 2, 3]) as s) where place + s - 1 <= of
), later as (
    select doc_id, place, s, row_number() over (partition by run, total < 13 and s < 3 order by doc_id, place) as k
    from w where s = 3 or total >= 13 or s = of
), gone as (
    select distinct doc_id, unnest(range(place, place + s)) as place from later where k > 1
), kept as (
    select l.doc_id, string_agg(l.line, chr(10) order by l.ln) as t
    from l left join n using (doc_id, ln) left join gone on gone.doc_id = n.doc_id and gone.place = n.place
    where gone.place is null group by l.doc_id
), sizes as (
    select doc_id, count(*) as n_lines from n group by doc_id
), removed as (
    select doc_id, count(*) as n_removed from gone group by doc_id
)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from documents left join sizes using (doc_id) left join removed using (doc_id) left join kept using (doc_id)
"""


@query("op9_line_dedup", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeated_runs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_substring_dedup", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP11_SQL = r"""
with d as (
    select coalesce(lang, 'und') as lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents
), pieces as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
    from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)
), totals as (
    select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang
), f as (
    select lang, size, phrase, count(*) as f
    from (
        select lang, size, unnest([array_to_string(w[p:p + size - 1], ' ') for p in range(1, len(w) - size + 2)]) as phrase
        from pieces, (select unnest(range(1, 6)) as size) where len(w) >= size
    ) group by all having count(*) >= 100
), c as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1
), cuts as (
    select c.*, k, array_to_string(w[1:k], ' ') as first_part, array_to_string(w[k + 1:], ' ') as rest
    from c, (select unnest(range(1, 5)) as k) where k < size
), scored as (
    select cuts.lang, cuts.size, cuts.phrase, a, n, k, x.f as l, y.f as r,
           cast((1000 * cast(a as hugeint) * n) // (cast(x.f as hugeint) * y.f) as bigint) as score
    from cuts join totals using (lang)
    join f x on x.lang = cuts.lang and x.phrase = first_part
    join f y on y.lang = cuts.lang and y.phrase = rest
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_phrases as (
    select lang, phrase, max(a) as longer
    from (
        select lang, a, unnest(flatten([[array_to_string(w[p:p + s - 1], ' ') for p in range(1, size - s + 2)] for s in range(2, size)])) as phrase
        from c where size > 2
    ) group by lang, phrase
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score,
       cast(k as bigint) as k
from best left join inner_phrases using (lang, phrase)
where longer is null or 100 * longer < 100 * a
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


@query("op11_phrase_collocations", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP13_SQL = r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), known as (
    select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id
), f as (
    select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
           [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
            100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'),
            doc_id > min(doc_id) over (partition by t)] as fails
    from d left join known using (doc_id)
), same as (
    select part, good, toxic, fails, count(*) as c from f group by all
), letters as (
    select unnest(string_split('ABCDE', '')) as x
), orders as (
    select concat(v.x, w.x, x.x, y.x, z.x) as filter_order
    from letters v, letters w, letters x, letters y, letters z
    where len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5
), taken as (
    select part, good, toxic, c, filter_order, [fails[strpos('ABCDE', filter_order[s])] for s in range(1, 6)] as failing
    from same, orders
), judged as (
    select *, coalesce(nullif(list_position(failing, true), 0), 6) as gone, len(list_filter(failing, lambda z: z)) as n_failing
    from taken
), told as (
    select part, filter_order, step,
           coalesce(sum(c) filter (gone > step), 0) as kept,
           coalesce(sum(c) filter (gone = step), 0) as removed,
           coalesce(sum(c) filter (failing[step] and gone < step), 0) as redundant,
           coalesce(sum(c) filter (failing[step] and n_failing = 1), 0) as unique_fails,
           coalesce(sum(c) filter (gone = step and good), 0) as good_lost,
           coalesce(sum(c) filter (gone = step and toxic), 0) as toxic_lost
    from judged, (select unnest(range(1, 6)) as step) group by part, filter_order, step
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, filter_order[step]) as bigint) as shapley
from told
"""


@query("op13_filter_audit", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
