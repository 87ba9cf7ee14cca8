"""One registered query per operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm import cross_tokens, filter_audit, license_scan, line_dedup, mixing, near_dup, packing, quality_model, quality_rules, suffix_dedup, token_files, url_filter, vp_search
from entityframe.llm.text import STOP_WORDS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for group in STOP_WORDS.values() for w in group}))
RULES_SQL = f"""
with base as (
    select doc_id, coalesce(lower(lang) in ('de', 'en', 'es', 'fr'), true) as listed, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines, coalesce(text, '') as text
    from documents
), runs as (
    select doc_id, i, count(*) over (partition by doc_id, run) as times
    from (select doc_id, i, hash(words[i : i + 7]) as run from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from base))
), repeated as (
    select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from runs where times > 1) group by doc_id
), counted as (
    select doc_id, listed, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
        cast(len(regexp_extract_all(text, '[#*$%&|<>!?=+~^{{}}\\[\\]\\\\]')) as bigint) as n_marks,
        cast(len(list_filter(words, lambda w: lower(w) in ({_STOPS}))) as bigint) as n_stops, cast(len(lines) as bigint) as n_lines,
        cast(coalesce(list_max(list_transform(words, lambda w: length(w))), 0) as bigint) as longest_word_chars
    from base left join repeated using (doc_id)
), shares as (
    select *, if(n_words > 0, word_chars::double / n_words, 0::double) as mean_word_chars, if(n_words > 0, n_symbols::double / n_words, 0::double) as symbol_ratio,
        if(n_words > 0, n_marks::double / n_words, 0::double) as mark_ratio, if(n_words > 0, n_stops::double / n_words, 0::double) as stop_word_ratio,
        if(n_lines > 0, n_dup_lines::double / n_lines, 0::double) as dup_line_ratio,
        n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
    from counted
)
select * exclude (listed), not base_failed and mean_word_chars >= 2 and mean_word_chars <= 20 and longest_word_chars <= 1000 and symbol_ratio <= 0.2
    and mark_ratio <= 0.5 and (stop_word_ratio >= 0.02 or not listed) and dup_line_ratio <= 0.5 as kept
from shares
"""


@query(RULES_SQL)
def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query()
def op1_quality_rule_ensemble(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.learn(docs, table(spark, sf_dir, "labels")))


@query()
def op2_minmax_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query()
def op9_fuzzy_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), whole=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op10_pfair_mixing(spark, sf_dir):
    out = mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", "block", "release", "deadline", "slot", "in_block")


@query()
def op3_conflict_best_fit(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op5_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op8_simple8b_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op7_vantage_point_search(spark, sf_dir):
    return vp_search.nearest(table(spark, sf_dir, "embeddings"))


@query()
def op4_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op12_lockstep_alignment(spark, sf_dir):
    import public_tokenizers

    return cross_tokens.align(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


AUDIT_SQL = """
with words as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
    from documents
), marked as (
    select doc_id, coalesce(max(if(quality = 1, 1, 0)), 0) as good, coalesce(max(if(toxic = 1, 1, 0)), 0) as toxic from labels group by doc_id
), masks as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        if(len(w) < 50, 1, 0) + if(100 * len(list_distinct(w)) < 65 * len(w), 2, 0)
            + if(100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), 4, 0) + if(regexp_matches(text, '[#$%&*|]'), 8, 0)
            + if(coalesce(doc_id > min(doc_id) over (partition by text), false), 16, 0) as mask
    from words left join marked using (doc_id)
), cells as (
    select part, mask, count(*) as n, sum(good) as g, sum(toxic) as t from masks group by part, mask
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (
    select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit,
        coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::bigint as before
    from orders, (select unnest(range(1, 6)) as step)
)
select part, filter_order, cast(step as integer) as step,
    cast(sum(if(mask & (bit | before) = 0, n, 0)) as bigint) as kept,
    cast(sum(if(mask & bit <> 0 and mask & before = 0, n, 0)) as bigint) as removed,
    cast(sum(if(mask & bit <> 0 and mask & before <> 0, n, 0)) as bigint) as redundant,
    cast(sum(if(mask = bit, n, 0)) as bigint) as unique_fails,
    cast(sum(if(mask & bit <> 0 and mask & before = 0, g, 0)) as bigint) as good_lost,
    cast(sum(if(mask & bit <> 0 and mask & before = 0, t, 0)) as bigint) as toxic_lost,
    cast(sum(if(mask & bit <> 0, n * (120 // greatest(bit_count(mask::bigint), 1)), 0)) as bigint) as shapley
from cells, steps group by part, filter_order, step
"""


@query(AUDIT_SQL)
def op13_retraction_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.count_masks(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


def _url_sql() -> str:
    """Rules by a case of the longest first; host scores by one table per round."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    host = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {q(url_filter._UPPER)}, {q(url_filter._LOWER)})"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
    longest = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = {q(r.host)} or ends_with(host, {q('.' + r.host)})) and starts_with(path, {q(r.path)})"
    case = lambda value: "case " + " ".join(f"when {fits(r)} then {q(value(r))}" for r in longest) + " end"
    d = url_filter.DAMPING
    rounds = [
        f"""r{n} as materialized (
    select kind, host, (seed * {100 - d}) // 100 + (coalesce(arrived, 0) // 100) * {d} + ((coalesce(arrived, 0) % 100) * {d}) // 100 as score
    from seeds left join (
        select kind, dst as host, sum(score // outs)::bigint as arrived from ways join r{n - 1} using (kind, host) group by all
    ) using (kind, host)
)"""
        for n in range(1, url_filter.ROUNDS + 1)
    ]
    return f"""
with placed as materialized (
    select page_id, {host} as host, {path} as path, html from pages
), judged as materialized (
    select page_id, host, path, html, {case(lambda r: r.name)} as rule, {case(lambda r: r.verdict)} as rule_verdict from placed
), named as (
    select distinct host as src, trim(translate(run, {q(url_filter._UPPER)}, {q(url_filter._LOWER)}), {q(url_filter.EDGES)}) as dst
    from (select host, unnest(regexp_split_to_array(html, {q(url_filter.SEPARATORS)})) as run from judged) where contains(run, '.')
), edges as materialized (
    select src, dst from named where src <> '' and dst <> '' and src <> dst and dst in (select host from judged)
), ways as materialized (
    select *, count(*) over (partition by kind, host) as outs
    from (select 'trust' as kind, src as host, dst from edges union all select 'distrust', dst, src from edges)
), seeds as materialized (
    select 'trust' as kind, host, (count(*) filter (rule_verdict = 'allow') * {url_filter.UNIT}) // count(*) as seed from judged where host <> '' group by host
    union all
    select 'distrust', host, (count(*) filter (rule_verdict = 'block') * {url_filter.UNIT}) // count(*) from judged where host <> '' group by host
), r0 as materialized (
    select kind, host, seed as score from seeds
), {", ".join(rounds)}, blocked as (
    select host from r{url_filter.ROUNDS} group by host
    having max(score) filter (kind = 'distrust') * 100 > max(score) filter (kind = 'trust') * {url_filter.MARGIN}
)
select page_id, host, path, rule, coalesce(rule_verdict, if(host in (select host from blocked), 'block', 'allow')) as verdict from judged
"""


@query(_url_sql())
def op11_link_graph_urls(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES)
