"""DuckDB SQL for the queries that SQL can express, written apart from their code."""

from __future__ import annotations

SHARDS = """
WITH byte_table AS (
  SELECT list_transform(range(256), lambda b : list_reduce(
    list_prepend(b, range(8)), lambda acc, i : CASE WHEN acc % 2 = 1 THEN xor(3988292384, acc // 2) ELSE acc // 2 END)) AS t
), docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), sums AS (
  SELECT doc_id, k, strlen(body) + 1 AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(body)), lambda i : ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda acc, b : xor(acc // 256, t[xor(acc % 256, b) + 1]))) AS text_crc32
  FROM docs, byte_table
), draws AS (
  SELECT *, ('0x' || substr(md5(k || '/slot'), 1, 7))::BIGINT % 1024 AS bucket,
    list_sort(list_transform([0, 1], lambda n : {'c': -ln(DRAW(region)) / 8.0, 'n': n}))[1] AS old_region,
    {'c': -ln((('0x' || substr(md5(k || '/region/2'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / 1.0, 'n': 2} AS new_region
  FROM sums
), racks AS (
  SELECT *, list_sort(list_transform([0, 1], lambda j : {'c': -ln(DRAW(rack)) / 4.0, 'n': 2 * old_region.n + j}))[1].n AS rack FROM draws
), placed AS (
  SELECT *, list_sort(list_transform([0, 1, 2, 3], lambda j : {'c': -ln(DRAW(shard)), 'n': 4 * rack + j}))[1].n AS shard FROM racks
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  (CASE WHEN new_region.c < old_region.c THEN 16 ELSE shard END)::INTEGER AS grown_shard
FROM placed
"""
for level, child in (("region", "n"), ("rack", "(2 * old_region.n + j)"), ("shard", "(4 * rack + j)")):
    SHARDS = SHARDS.replace(
        f"DRAW({level})", f"(('0x' || substr(md5(k || '/{level}/' || {child}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0",
    )

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(20 + length(regexp_replace(role, '[\[<\\]', '..', 'g')) + length(regexp_replace(text, '[\[<\\]', '..', 'g'))) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM whole
"""

ARCHIVE = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), ranked AS (
  SELECT page_id, payload_bytes, sha256(body) AS payload_digest,
    row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST, url NULLS FIRST) AS place,
    first_value(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST, url NULLS FIRST) AS leader
  FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN place > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN place > 1 AND payload_bytes >= 100 THEN leader END AS refers_to
FROM ranked
"""

TOP_K = """
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM rows q JOIN rows d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

PASSAGES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT rid, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS low FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM windows JOIN firsts USING (s) WHERE low < doc_id
), word_rows AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs
), kept AS (
  SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS body FROM word_rows ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

RESAMPLED = r"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda b : list_reduce(
    list_prepend(b, range(8)), lambda acc, i : CASE WHEN acc % 2 = 1 THEN xor(3988292384, acc // 2) ELSE acc // 2 END)) AS t
), bodies AS (
  SELECT 's' AS side, row_number() OVER () AS rid, doc_id AS id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark
), texts AS MATERIALIZED (
  SELECT side, rid, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM bodies
), grams AS (
  SELECT side, rid, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM texts
), features AS MATERIALIZED (
  SELECT side, rid, f, count(*) AS n FROM grams GROUP BY ALL
), spelled AS (
  SELECT f, strlen(f) AS size, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), hashed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size), lambda i : ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda acc, b : xor(acc // 256, t[xor(acc % 256, b) + 1]))) % 10000 AS bucket
  FROM spelled, byte_table
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
  FROM features JOIN hashed USING (f) GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, totals
), weights AS (
  SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY rid
), scored AS (
  SELECT rid, id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (rid) WHERE side = 's'
), able AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN able USING (rid)
"""

CODES = """
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x : floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), width AS (
  SELECT (max(len(v)) + 7) // 8 AS size FROM vectors
), points AS MATERIALIZED (
  SELECT rid, (i // size)::INTEGER AS part, (i % size)::INTEGER AS pos, coalesce(v[i + 1], 0) AS x
  FROM (SELECT rid, v, size, unnest(range(8 * size)) AS i FROM vectors, width)
), seeds AS (
  SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS entry
  FROM (SELECT vec_id, min(v) AS v FROM vectors WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 16)
), book0 AS MATERIALIZED (
  SELECT (i // size)::INTEGER AS part, entry, (i % size)::INTEGER AS pos, coalesce(v[i + 1], 0) AS c
  FROM (SELECT entry, v, size, unnest(range(8 * size)) AS i FROM seeds, width)
), ROUNDS
named AS (
  SELECT rid, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM near6 GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book6) AS codebooks_sha256
FROM vectors JOIN named USING (rid)
"""
NEAREST = """near{k} AS MATERIALIZED (
  SELECT rid, part, entry, gap FROM (
    SELECT rid, part, entry, sum((x - c) * (x - c)) AS gap FROM points JOIN book{k} USING (part, pos) GROUP BY rid, part, entry
  ) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY gap, entry) = 1
), """
MOVED = """book{n} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m.c, b.c)::BIGINT AS c FROM book{k} b LEFT JOIN (
    SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS c FROM near{k} JOIN points USING (rid, part) GROUP BY part, entry, pos
  ) m USING (part, entry, pos)
), """
CODES = CODES.replace("ROUNDS\n", "".join(NEAREST.format(k=k) + (MOVED.format(k=k, n=k + 1) if k < 6 else "") for k in range(7)))

ORACLE_SQL: dict[str, str] = {
    "op3_hash_tree_shards": SHARDS, "op4_voronoi_top_k": TOP_K, "op6_chat_format": CHATS, "op7_warc_archive": ARCHIVE,
    "op11_suffix_automata": PASSAGES, "op12_importance_resampling": RESAMPLED, "op13_orchard_codes": CODES,
}
