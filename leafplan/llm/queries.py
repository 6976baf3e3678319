"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kn_classifier, media, mixing, near_dedup, piece_codec, quality_rules, sharding, token_counts, token_files, url_filter

#: Target weights: every source has the same share, but for two.
SOURCE_WEIGHTS = {"src1": 2.0, "src2": 0.5}
SHARDS = 40
END_ID = 2

#: Site rules and, for places that they leave open, words of unwanted sites.
URL_RULES = tuple(
    url_filter.parse_rules("""
allow com/
block example.com/en/
allow www.example.com/en/
block net/es/
block net/fr/
block ~spam-farm
block ~cheap-pills
block ~casino-win
block ~adult-x
block ~free-bets
block ~ads-track
""")
)


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated to ``SOURCE_WEIGHTS`` and shuffled: their columns, ``copy`` and ``shuffle_key``.

    Null texts count as empty. A row for each row drawn, repeats too; an empty table gives no rows.
    """
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every document.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), carry=["doc_id"])


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards, law ``key``; ``grown_shard`` is the place with a shard more.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    tree = sharding.even_tree(SHARDS)
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), tree, sharding.with_new_shard(tree))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back from its archive, with sizes, checksums and a feature.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    return media.media_table(_table(spark, sf_dir, "documents"), with_media=False)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files written.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=END_ID)
    return token_files.read_token_files(files, with_ids=False)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, pattern (of an unwanted site) and verdict of every page.

    Null url: empty host and path. A row for each row, repeats too; an empty table gives no rows.
    """
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "pattern", "verdict")


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_bytes, log_perplexity, threshold and kept of every document; fitted on the trusted rows of ``labels``.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    out = kn_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_bytes", "log_perplexity", "threshold", "kept")


def op10_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and checksums of the piece ids and of their decoding, of every document.

    Null texts count as empty. A row for each row, repeats too; an empty table gives no rows.
    """
    return piece_codec.piece_digests(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), carry=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents.

    Null texts count as empty. A row for each row that the stages keep and draw, repeats too; an empty table gives no rows.
    """
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_poisson_mix, op2_rule_cascade, op3_trie_token_counts, op4_hash_tree_shards, op5_media_archive, op6_minhash_dedup, op7_rans_token_files, op8_url_rules, op9_kneser_ney_quality, op10_suffix_array_pieces, pipeline)
}

_OP1 = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(SUM(length(coalesce(text, '')) + 1) AS DOUBLE) AS size,
         CASE source WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE * (weight / (SELECT SUM(weight) FROM sizes)) * (SELECT SUM(size) FROM sizes) / size AS rate FROM sizes),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
draws AS (
  SELECT *, ('0x' || substr(md5('mix:0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.c <= d.u) AS copies
  FROM draws d),
copied AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(copies)) AS INTEGER) AS copy FROM counted)
SELECT *, ('0x' || substr(md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)), 1, 13))::BIGINT AS shuffle_key FROM copied
"""

_OP8 = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts),
rules(name, verdict, host, path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
kinds(name) AS (VALUES ('spam-farm'), ('cheap-pills'), ('casino-win'), ('adult-x'), ('free-bets'), ('ads-track')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(n := r.name, v := r.verdict), length(r.name)) FROM rules r
     WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)) AS won,
    (SELECT arg_max(k.name, struct_pack(l := length(k.name), n := -ascii(k.name))) FROM kinds k
     WHERE regexp_matches(s.host || s.path, '(^|[./-])' || k.name || '[./-]')) AS kind
  FROM split s)
SELECT page_id, host, path, won.n AS rule, CASE WHEN won IS NULL THEN kind END AS pattern,
       CASE WHEN won IS NOT NULL THEN won.v WHEN kind IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
pos AS (SELECT r, w, i, lag(w) OVER x AS before, w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x || ' ' || lead(w, 3) OVER x || ' ' || lead(w, 4) OVER x AS g FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM pos WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM line WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
words AS (SELECT r, count(*) AS n, sum(length(w))::BIGINT AS chars, count(*) FILTER (WHERE w = before) AS stutter, count(*) FILTER (WHERE NOT regexp_matches(w, '\p{{L}}')) AS wordless,
  count(*) FILTER (WHERE length(w) > 1 AND regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '[\p{{Ll}}\p{{Lt}}]')) AS upper FROM pos GROUP BY r),
base AS (SELECT d.doc_id, coalesce(words.n, 0) AS n_words, coalesce(chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^!]', '', 'g')) AS bangs, coalesce(lines.n, 0) AS n_lines, coalesce(stutter, 0) AS stutter, coalesce(wordless, 0) AS wordless, coalesce(upper, 0) AS upper
  FROM d LEFT JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.1 * n_words OR bangs > 0.1 * n_words OR upper > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines OR stutter > 0.3 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR wordless > 0.7 * n_words) AS kept FROM base
"""

# All pairs that share a shingle: fit for small tables only.
_OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM places),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.c + ny.c - i)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_poisson_mix": _OP1, "op2_rule_cascade": _OP2, "op6_minhash_dedup": _OP6, "op8_url_rules": _OP8}
