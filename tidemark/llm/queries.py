"""The registered queries of this subpackage, with their DuckDB twins where SQL
can express them."""

from __future__ import annotations

from tidemark.llm import (
    chat,
    divergence,
    exact_topk,
    html_text,
    license_scan,
    merkle,
    mixing,
    nearest,
    packing,
    quality,
    sharding,
    simhash,
    url_filter,
)
from tidemark.llm.frames import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scans(spark, sf_dir):
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op3_quality_classifier(spark, sf_dir):
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


# Verdict, host, path: the rules of the registered query (fixed values).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op4_url_filters(spark, sf_dir):
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_topk(spark, sf_dir):
    return exact_topk.exact_topk(read(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark, sf_dir):
    return nearest.nearest_vectors(read(spark, sf_dir, "embeddings"))


def op9_chat_formatting(spark, sf_dir):
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def op12_html_extraction(spark, sf_dir):
    return html_text.extract_main_text(read(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scans, op2_simhash_near_dedup, op3_quality_classifier, op4_url_filters,
    op5_exact_topk, op6_source_mixing, op7_sharding, op8_nearest_neighbours,
    op9_chat_formatting, op10_best_fit_packing,
    op11_source_divergence, op12_html_extraction, op13_merkle_manifest)}

# Each url's fitting rules by plain comparison, the longest first.
_URL_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)



def _field_sql(value: str, size: str) -> str:
    return f"coalesce({size} || ':' || {value}, '-')"


def _merkle_sql(levels: int = 7, group_levels: int = 2) -> str:
    """The manifest level by level, for up to 8 ** ``levels`` rows in a language:
    each level's nodes, and each leaf's proof and folded digest, as one table."""
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    number = [_field_sql(f"CAST({c} AS VARCHAR)", f"length(CAST({c} AS VARCHAR))")
              for c in ("doc_id", "n_chars")]
    word = [_field_sql(c, f"strlen({c})") for c in ("source", "lang")]
    head = f"{number[0]} || {word[0]} || {word[1]} || {number[1]}"
    low = f"translate(text, {upper}, {lower})"
    # CRC-32 by its polynomial, bit by bit, over the digits of the id.
    step = "xor(x >> 1, 3988292384 * (x & 1))"
    crc = (f"xor(list_reduce([ascii(c) for c in string_split(CAST(doc_id AS VARCHAR), '')], "
           f"lambda a, c: list_reduce(range(8), lambda x, i: {step}, xor(a, c)), 4294967295::BIGINT), "
           f"4294967295)")
    sql = [f"""rows0 AS (
    SELECT doc_id, lang, sha256({head} || {_field_sql('text', 'strlen(text)')}) AS leaf,
           CASE WHEN {crc} % 3 = 0
                THEN sha256({head} || {_field_sql(low, f'strlen({low})')}) END AS other
    FROM documents),
at0 AS (
    SELECT doc_id, lang, leaf, coalesce(other, leaf) AS folded, '' AS proof,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows0),
n0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS total FROM at0)"""]

    def climb(at: str, nodes: str, new_at: str, new_nodes: str, keep: str, key: str) -> list[str]:
        run = f"SELECT {key}, i // 8 AS run, total, list(h ORDER BY i) AS hs FROM {nodes} GROUP BY ALL"
        up = (f"{new_nodes} AS (SELECT {key}, CASE WHEN total > 1 THEN run ELSE i0 END AS i, "
              f"CASE WHEN total > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, "
              f"CASE WHEN total > 1 THEN (total + 7) // 8 ELSE total END AS total "
              f"FROM (SELECT *, 0 AS i0 FROM ({run})))")
        down = (f"{new_at} AS (SELECT {keep}, a.i // 8 AS i, "
                f"CASE WHEN total > 1 THEN proof || array_to_string(hs[:a.i % 8], '') "
                f"|| array_to_string(hs[a.i % 8 + 2:], '') ELSE proof END AS proof, "
                f"CASE WHEN total > 1 THEN sha256(array_to_string(hs[:a.i % 8], '') || folded "
                f"|| array_to_string(hs[a.i % 8 + 2:], '')) ELSE folded END AS folded "
                f"FROM {at} a JOIN ({run}) r ON r.{key} IS NOT DISTINCT FROM a.{key} AND r.run = a.i // 8)")
        return [down, up]

    for k in range(levels):
        sql += climb(f"at{k}", f"n{k}", f"at{k + 1}", f"n{k + 1}", "doc_id, a.lang, leaf", "lang")
    sql.append(f"""g0 AS (SELECT 0 AS one, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i,
    count(*) OVER () AS total FROM n{levels})""")
    sql.append(f"""top0 AS (SELECT 0 AS one, a.doc_id, a.lang, a.leaf, a.proof, a.folded, g.i, n.h AS subroot
    FROM at{levels} a JOIN n{levels} n ON n.lang IS NOT DISTINCT FROM a.lang
    JOIN g0 g ON g.h = n.h AND g.i = (SELECT count(*) FROM n{levels} b WHERE n.lang IS NOT NULL
                                      AND (b.lang IS NULL OR b.lang < n.lang)))""")
    for k in range(group_levels):
        sql += climb(f"top{k}", f"g{k}", f"top{k + 1}", f"g{k + 1}",
                     "a.one, doc_id, lang, leaf, subroot", "one")
    return f"""WITH {", ".join(sql)}
SELECT doc_id, lang, leaf, subroot, h AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = h AS verified
FROM top{group_levels} t JOIN g{group_levels} g ON g.one = t.one"""


_DIVERGENCE_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (
    SELECT d, lang, source,
           unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
every AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n
          FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
shares AS (
    SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER grp + 2 * count(*) OVER grp) AS p
    FROM every WINDOW grp AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL),
whole_shares AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2))
           // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL),
both_parts AS (
    SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
    FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
    LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q)
    FROM shares JOIN whole_shares USING (lang, term) WHERE n > 0 AND p > q),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
    FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM numbered WHERE part = 'pair' OR r <= 10"""

# Every query against every row; vectors of one length, of finite numbers.
_TOPK_SQL = """
WITH f AS (
    SELECT vec_id, row_number() OVER () AS place,
           list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, q.place AS asked, r.vec_id, r.place,
           CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
    FROM f q JOIN f r ON q.place <> r.place
    WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score,
       CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id, place) AS INTEGER) AS rank
FROM scores
QUALIFY rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": _TOPK_SQL,
    "op11_source_divergence": _DIVERGENCE_SQL,
    "op13_merkle_manifest": _merkle_sql(),
    "op4_url_filters": f"""
WITH rules AS (SELECT * FROM (VALUES {_URL_RULES_SQL}) r(kind, rule_host, rule_path)),
parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages)
SELECT page_id, host, path,
       (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host))
              AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT arg_max(kind, length(rule_host || rule_path)) FROM rules
                 WHERE (host = rule_host OR ends_with(host, '.' || rule_host))
                       AND starts_with(path, rule_path)), '{url_filter.DEFAULT_VERDICT}') AS verdict
FROM parts""",
}
