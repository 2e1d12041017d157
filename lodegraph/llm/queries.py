"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, katz, license_scan, line_dedup, minhash, packing, pii_crf, quality_cnn, quality_rules, sharding


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), n_shards=8).drop("row_number")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), capacity=4096, end_id=2, with_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digest(pii_crf.find(_documents(spark, sf_dir)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_paragraphs", "n_licence", "n_unknown", F.array_join("families", ",").alias("families"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), percent=85)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = common.id_bucket(F.col("doc_id"), 7) == 2
    model = katz.fit(docs.filter(~held_out))
    found = katz.score(docs, model)
    model.close()
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_minhash": op9_minhash,
    "op10_katz": op10_katz,
}

#: DuckDB's equivalents, where SQL can express the result.
ORACLE_SQL: dict[str, str] = {
    "op9_minhash": """
        with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
        sets as (select doc_id, list_distinct(case when len(ws) < 5 then (case when len(ws) = 0 then [] else [array_to_string(ws, ' ')] end)
            else list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as grams from words),
        sizes as (select doc_id, len(grams) as n from sets),
        grams as (select doc_id, unnest(grams) as x from sets),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * shared >= 85 * (s.n + t.n - shared)),
        edges as (select a, b from links union all select b, a from links),
        reach as (select doc_id as node, doc_id as root from sizes union select r.node, e.b from reach r join edges e on r.root = e.a),
        least as (select node, min(root) as component_id from reach group by 1)
        select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join least on node = doc_id""",
    "op1_line_dedup": """
        with docs as (select doc_id, coalesce(text, '') as text from documents),
        lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
        keyed as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
        frequent as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10),
        marked as (select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
    "op5_quality_rules": f"""
        with words as (select doc_id, lang, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
        windows as (select doc_id, i, list_slice(ws, i, i + 4) as g from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as i from words where len(ws) >= 5)),
        twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from windows) where c > 1),
        covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + 4)) as p from twice) group by 1),
        lined as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from words),
        counts as (select l.doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
            len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(regexp_extract_all(t, '!')) as n_marks, len(regexp_extract_all(t, '[A-Z]')) as n_capitals,
            len(ls) as n_lines, len(list_filter(generate_series(1, len(ws) - 1), lambda i: ws[i] = ws[i + 1])) as n_adjacent
            from lined l left join covered c using (doc_id)),
        ratios as (select *, unnest([{", ".join(f"{{'rule': '{name}', 'x': case when {under} > 0 then (1000 * {over}) // {under} else 0 end}}" for name, over, under, _ in quality_rules.RULES)}], recursive := true) from counts),
        cutoffs(rule, step, cutoff) as (values {", ".join(f"('{name}', {i}, {c})" for name, _, _, cs in quality_rules.RULES for i, c in enumerate(cs))}),
        good as (select doc_id from labels where quality in (0, 1) group by doc_id having min(quality) = 1),
        held as (select lang, rule, step, cutoff, count(*) as n, count(*) filter (x > cutoff) as k from ratios join good using (doc_id) join cutoffs using (rule) group by all),
        tests as (select *, (select count(*) from (select distinct lang from held)) as strata from held),
        tried as (select *, case when k > n * 0.01 then false else list_sum(list_transform(generate_series(0, k),
            lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) <= 0.05 / (6 * strata) end as ok from tests),
        proven as (select lang, rule, min(cutoff) as cutoff from (select *, bool_and(ok) over (partition by lang, rule order by step) as every from tried) where every group by 1, 2),
        failed as (select r.doc_id, bool_or(x > p.cutoff) as bad from ratios r join proven p on r.lang = p.lang and r.rule = p.rule group by 1)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
            not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(bad, false) as kept
        from counts left join failed using (doc_id)""",
}
