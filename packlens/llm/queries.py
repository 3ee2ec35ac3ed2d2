"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_query
from .common import read_table
from .digests import fingerprint_query
from .jaccard import jaccard_query
from .lm import lm_query
from .media import media_query
from .mixing import mix_query
from .periodic import periodic_query
from .quality import quality_query
from .resample import resample_query
from .simhash import simhash_query
from .substrings import substring_query
from .suffixes import suffix_query
from .warc import warc_query

Query = Callable[[SparkSession, str], DataFrame]


def over(table: str, query: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(spark, read_table(spark, sf_dir, table))


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": over("documents", fingerprint_query),
        "op2_bpe": over("documents", bpe_query),
        "op3_warc": over("pages", warc_query),
        "op4_substrings": over("documents", substring_query),
        "op5_media": over("documents", media_query),
        "op6_mixing": over("documents", mix_query),
        "op7_lm": over("documents", lm_query),
        "op8_quality": quality_query,
        "op9_simhash": over("documents", simhash_query),
        "op10_suffixes": over("documents", suffix_query),
        "op11_resample": resample_query,
        "op12_periods": over("documents", periodic_query),
        "op13_jaccard": over("documents", jaccard_query),
    }


#: SHA-1 in bare base32: five hexadecimal digits are four characters.
BASE32 = "list_aggregate(list_transform(range(8), lambda j: " + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * j + 1, 5))::INTEGER >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)) + "), 'string_agg', '')"

#: CRC-32 of each distinct word of table ``v(word)``, by table ``k(entries)`` of 256 remainders.
CRC32 = """
        k AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS entries),
        c AS (SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
          lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM v, k)"""

ORACLES = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        f AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op4_substrings": """
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM t),
        g AS (SELECT doc_id, word, i, CASE WHEN i + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS win FROM w),
        s AS (SELECT doc_id, word, i, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS starts FROM g),
        c AS (SELECT doc_id, word, i, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""",
    "op10_suffixes": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM t),
        g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 400 <= length(h) THEN md5_number(substr(h, 2 * i + 1, 400)) END AS win FROM b),
        s AS (SELECT doc_id, i, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS starts FROM g),
        c AS (SELECT doc_id, i, byte, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM s),
        r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
        k AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""",
    "op13_jaccard": """
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM t WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT shingle, count(*) AS df FROM s GROUP BY 1),
        o AS (SELECT doc_id, shingle, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) AS place FROM s JOIN c USING (shingle) JOIN n USING (doc_id)),
        f AS (SELECT doc_id, shingle, n FROM o WHERE place <= n - (90 * n + 99) // 100 + 1),
        p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM f a JOIN f b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
        e AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.shingle = b.shingle JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
          GROUP BY x, y, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
        b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r AS (SELECT x AS node, x AS far FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.far),
        m AS (SELECT node, min(far) AS least FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id""",
    "op11_resample": rf"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        v AS (SELECT word FROM d UNION SELECT word FROM b),{CRC32},
        s AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM d JOIN c USING (word) GROUP BY 1), t AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM b JOIN c USING (word) GROUP BY 1),
        z AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t_all),
        g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((s.n + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
        w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM d JOIN c USING (word) JOIN g ON g.bucket = c.crc % 10000 GROUP BY 1),
        f AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
          ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
        r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM f),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
        SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= 10 * (SELECT count(*) FROM o) // 100 THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
