"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, lm, packing, quality, secrets, sharding, simhash, substring, urls, warc
from lodestar.llm.common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats_report(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(read_table(spark, sf_dir, "pages"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), scan=True)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# --- the columns that the contracts fix without the method, as queries that SQL can hold them to -------------


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def sharding_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards' counts: of n rows each of 40 shards has as many as dealing them out gives it."""
    return op3_sharding(spark, sf_dir).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def urls_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


OPERATORS = (op1_packing, op2_secrets, op3_sharding, op4_simhash, op5_quality, op6_substrings, op7_warc, op8_lm, op9_urls, op10_decontamination)
BASES = (secrets_base, sharding_base, quality_base, urls_base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, *BASES)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RULES = sorted(urls.RULES, key=lambda r: -len(r.name))
_FITS = " ".join("when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{v}'".format(h=r.host, p=r.path, v="{" + r.name + "}") for r in _RULES)


def _rule_case(value: Callable[[urls.UrlRule], str]) -> str:
    out = _FITS
    for r in _RULES:
        out = out.replace("{" + r.name + "}", value(r))
    return f"case {out} end"


SQL = {
    # Removed words: those of windows of 13 words whose words also start a window in a document with a smaller id.
    "op6_substrings": f"""
        with d as (select doc_id, {_WORDS} w from documents),
        x as (select doc_id, i, array_to_string(w[i : i + 12], ' ') k from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) i from d where len(w) >= 13) y),
        o as (select k, min(doc_id) least from x group by 1),
        g as (select distinct doc_id, unnest(generate_series(i, i + 12)) j from x join o using (k) where least < doc_id),
        r as (select doc_id, count(*) n, list(j) js from g group by 1),
        t as (select d.doc_id, w, coalesce(n, 0) n, coalesce(js, []) js from d left join r using (doc_id)),
        p as (select doc_id, len(w) n_words, n n_removed, w, js from t),
        k as (select p.doc_id, string_agg(word, ' ' order by place) kept from (select doc_id, unnest(w) word, unnest(generate_series(1, len(w))) place from p) p left join g on g.doc_id = p.doc_id and g.j = p.place where g.j is null group by 1)
        select p.doc_id, cast(n_words as bigint) n_words, cast(n_removed as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from p left join k using (doc_id)""",
    "op7_warc": """
        with p as (select page_id, coalesce(html, '') h, cast(strlen(coalesce(html, '')) as bigint) payload_bytes from pages),
        g as (select h, max(page_id) target from p where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, sha1(p.h) payload_digest, case when target <> page_id then 'revisit' else 'response' end record_type, case when target <> page_id then target end refers_to from p left join g on p.h = g.h and payload_bytes >= 1000""",
    "secrets_base": r"""
        select doc_id, cast(len(list_filter(regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6)) as bigint) n_assign,
            cast(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) as bigint) n_access, cast(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24)) as bigint) n_hex
        from (select doc_id, coalesce(text, '') t from documents) x""",
    "sharding_base": "select cast(s as bigint) shard, count(*) n, cast(0 as bigint) first_slot, cast(count(*) - 1 as bigint) last_slot from (select (row_number() over () - 1) % 40 s from documents) x group by 1",
    "quality_base": f"""
        with d as (select row_number() over () r, doc_id, coalesce(text, '') t, {_WORDS} w from documents),
        x as (select r, i, array_to_string(w[i : i + 4], ' ') k from (select r, w, unnest(generate_series(1, len(w) - 4)) i from d where len(w) >= 5) y),
        m as (select r, count(distinct j) n from (select x.r, unnest(generate_series(x.i, x.i + 4)) j from x join (select r, k from x group by 1, 2 having count(*) > 1) y on x.r = y.r and x.k = y.k) z group by 1),
        l as (select r, count(*) - count(distinct line) n from (select r, unnest(string_split(t, chr(10))) line from d) y where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1)
        select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(list_sum(list_transform(w, lambda v: len(v))), 0) as bigint) word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols, cast(coalesce(l.n, 0) as bigint) n_dup_lines,
            cast(coalesce(m.n, 0) as bigint) n_repeat_words, len(w) < 10 or 100 * coalesce(m.n, 0) > 20 * len(w) base_failed from d left join m using (r) left join l using (r)""",
    "urls_base": f"""
        with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
        cut as (select page_id, regexp_extract(r, '^([^/?#]*)', 1) as h, r from rest),
        parts as (select page_id, lower(h) as host, regexp_extract(substr(r, length(h) + 1), '^([^?#]*)', 1) as path from cut)
        select page_id, host, path, {_rule_case(lambda r: r.name)} as rule, {_rule_case(lambda r: r.verdict)} as verdict from parts""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can state, and of the fixed columns of others; what isn't here is held against brute force in tests/llm."""
    return dict(SQL)
