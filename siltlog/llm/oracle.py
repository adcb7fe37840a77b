"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: The table of the cyclic redundancy check, by its rule: eight times a shift, with the polynomial where a bit falls out.
CRC = """
crc_step AS (
  SELECT b, 0 AS k, b AS v FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_step WHERE k = 8)"""

SHARDS = f"""
WITH RECURSIVE {CRC},
docs AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, source AS stratum, coalesce('s' || source, '') AS s,
         xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM docs, crc_table),
placed AS (SELECT *, CAST('0x' || substr(md5(concat('17|', doc_id, '|', text_crc32)), 1, 15) AS BIGINT) AS u FROM sized),
ranked AS (SELECT *, (CAST(row_number() OVER (PARTITION BY s ORDER BY u, doc_id, text_crc32, size) AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(count(*) OVER (PARTITION BY s) AS DOUBLE) AS f FROM placed),
lined AS (SELECT *, row_number() OVER (ORDER BY f, s, u, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // n AS INTEGER) AS shard, CAST(place - ((place * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, stratum
FROM lined"""

REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) AS i FROM docs)),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f < doc_id),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > 50, true) AS new FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grouped AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
runs AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM grouped GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

NEAR = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT edges.b AS doc_id, reach.r FROM reach JOIN edges ON edges.a = reach.doc_id),
roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)"""


def texts() -> dict[str, str]:
    return {"op5_stratified_sharding": SHARDS, "op7_bwt_substring_dedup": REPEATS, "op8_minhash_near_dedup": NEAR}
