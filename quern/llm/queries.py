"""The registered queries of the training-data operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.caps import embedding_components
from quern.llm.common import written
from quern.llm.exact_dedup import exact_dedup
from quern.llm.flac import media_features
from quern.llm.html_text import extract_text
from quern.llm.license_scan import scan_licenses
from quern.llm.merkle import manifest, verified
from quern.llm.mixing import mix_sources
from quern.llm.packing import pack
from quern.llm.pii import checked, pseudonymize
from quern.llm.resampling import resample
from quern.llm.secret_scan import KINDS, find_secrets, joined
from quern.llm.simhash import simhash_components
from quern.llm.toxicity import toxicity
from quern.runtime import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    base = joined(F.filter("found", lambda s: s["kind"] != KINDS[3]))
    return found.select("doc_id", *counts[:3], F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), counts[3])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Key of the registered query alone; whoever replaces real data passes a secret of their own.
DEMONSTRATION_KEY = b"quern demonstration key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = checked(written(pseudonymize(read(spark, sf_dir, "documents"), DEMONSTRATION_KEY)))
    places = F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["start"], e["end"]))
    return replaced.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(places, ",").alias("entities"), "text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_flac": op10_flac,
    "op11_resampling": op11_resampling,
    "op12_caps": op12_caps,
    "op13_merkle": op13_merkle,
}

#: CRC32 in SQL: the table of 256 remainders, and the checksum of a string over its bytes.
CRC_TABLE = """
        crc_steps(i, c, k) AS (
            SELECT range, range, 0 FROM range(256)
            UNION ALL
            SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
        crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str, table: str = "t") -> str:
    code = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_UP = "list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(list_slice(nodes, i + 1, i + 8), '')))"
#: Siblings (left, right) of place r on level k of a tree whose nodes of each level are lists.
_SIDES = """
            array_to_string(list_slice(nodes, r // pow8 // 8 * 8 + 1, r // pow8), '') AS l,
            array_to_string(list_slice(nodes, r // pow8 + 2, r // pow8 // 8 * 8 + 8), '') AS r"""

ORACLE_SQL: dict[str, str] = {
    "op11_resampling": rf"""
        WITH RECURSIVE {CRC_TABLE},
        lowered AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark)),
        listed AS (
            SELECT doc_id, len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM lowered),
        exploded AS (SELECT doc_id, unnest(f) AS feature FROM listed),
        per_doc AS (SELECT doc_id, feature, count(*) AS n FROM exploded GROUP BY ALL),
        dictionary AS (
            SELECT feature, {crc_sql("feature")} % 10000 AS bucket, n_s, n_t
            FROM (SELECT feature, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0) AS n_s, coalesce(sum(n) FILTER (doc_id IS NULL), 0) AS n_t
                  FROM per_doc GROUP BY feature), crc_table),
        by_bucket AS (SELECT bucket, sum(n_s)::DOUBLE AS s, sum(n_t)::DOUBLE AS t FROM dictionary GROUP BY bucket),
        totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM by_bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM by_bucket, totals),
        summed AS (
            SELECT doc_id, sum(n * gain)::BIGINT AS total FROM per_doc JOIN dictionary USING (feature) JOIN gains USING (bucket)
            WHERE doc_id IS NOT NULL GROUP BY doc_id),
        weighed AS (
            SELECT l.doc_id, n_words, len(f)::BIGINT AS n_features,
                   CASE WHEN len(f) = 0 THEN 0 ELSE (total - ((total % len(f)) + len(f)) % len(f)) // len(f) END::BIGINT AS weight
            FROM listed l LEFT JOIN summed USING (doc_id) WHERE l.doc_id IS NOT NULL),
        scored AS (
            SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM weighed),
        placed AS (
            SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
                   count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS drawn
            FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM placed""",
    "op12_caps": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
        FROM (SELECT vec_id, vec_id AS u FROM embeddings) LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) USING (u)
        LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) USING (u)""",
    "op13_merkle": rf"""
        WITH RECURSIVE {CRC_TABLE},
        leaves AS (
            SELECT doc_id, coalesce('1' || lang, '0') AS key, {_leaf_sql()} AS leaf,
                   CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0
                        THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql()} END AS changed
            FROM documents, crc_table),
        placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS r FROM leaves),
        lower_tree(key, k, nodes) AS (
            SELECT key, 0, list(leaf ORDER BY r) FROM placed GROUP BY key
            UNION ALL SELECT key, k + 1, {_UP} FROM lower_tree WHERE len(nodes) > 1),
        subroots AS (SELECT key, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(key)) - 1 AS r FROM lower_tree WHERE len(nodes) = 1),
        upper_tree(k, nodes) AS (
            SELECT 0, list(subroot ORDER BY r) FROM subroots
            UNION ALL SELECT k + 1, {_UP} FROM upper_tree WHERE len(nodes) > 1),
        whole AS (SELECT nodes[1] AS root FROM upper_tree WHERE len(nodes) = 1),
        sides AS (
            SELECT doc_id, p.key, leaf, k, {_SIDES}
            FROM (SELECT p.*, k, nodes, (8 ** k)::BIGINT AS pow8 FROM placed p JOIN lower_tree t ON p.key = t.key WHERE len(nodes) > 1) p
            UNION ALL
            SELECT doc_id, p.key, leaf, k + 1000, {_SIDES}
            FROM (SELECT p.doc_id, p.leaf, p.key, k, nodes, s.r, (8 ** k)::BIGINT AS pow8 FROM placed p JOIN subroots s ON p.key = s.key, upper_tree WHERE len(nodes) > 1) p),
        paths AS (SELECT doc_id, leaf, list({{'l': l, 'r': r}} ORDER BY k) AS path FROM sides GROUP BY doc_id, leaf),
        folding(doc_id, leaf, node, path, k) AS (
            SELECT p.doc_id, p.leaf, p.changed, coalesce(q.path, []), 0 FROM placed p LEFT JOIN paths q ON p.doc_id = q.doc_id AND p.leaf = q.leaf
            UNION ALL
            SELECT doc_id, leaf, sha256(path[k + 1].l || node || path[k + 1].r), path, k + 1 FROM folding WHERE k < len(path))
        SELECT f.doc_id, f.leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
               node AS folded_root, node = root AS verified
        FROM folding f JOIN placed p ON f.doc_id = p.doc_id AND f.leaf = p.leaf JOIN subroots s ON p.key = s.key, whole
        WHERE f.k = len(path)""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op4_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
        w AS (SELECT source, n, i, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / weight, i) AS k FROM w),
        c AS (
            SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
            FROM o),
        cutoff AS (SELECT rest, heavy FROM c WHERE 2.0 * n >= rest * weight / heavy ORDER BY k LIMIT 1),
        f AS (SELECT min(k) AS k FROM c WHERE 2.0 * n >= rest * weight / heavy),
        t AS (
            SELECT source, n, CASE WHEN c.k < (SELECT k FROM f) THEN (2 * n)::DOUBLE
                   ELSE (SELECT rest FROM cutoff)::DOUBLE * weight / (SELECT heavy FROM cutoff)::DOUBLE END AS target
            FROM c),
        b AS (
            SELECT source, n, target, (round_even(target, 0)::BIGINT // greatest(n, 1)) AS epochs,
                   round_even(target, 0)::BIGINT - (round_even(target, 0)::BIGINT // greatest(n, 1)) * n AS budget
            FROM t),
        r AS (
            SELECT d.doc_id, d.size, b.n AS source_size, b.target, b.epochs, b.budget,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + least(size, greatest(budget - before, 0)))::BIGINT AS taken
        FROM r""",
}
