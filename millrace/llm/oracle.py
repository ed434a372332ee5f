"""DuckDB SQL of the queries that SQL can express."""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"

OP11 = f"""
WITH tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {TERMS} AS t FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::bigint AS terms FROM n),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {TERMS} AS t FROM benchmark) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM asked) GROUP BY 1),
scores AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint
* ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint AS score
FROM asked JOIN df USING (t) JOIN tf USING (t) JOIN n USING (doc_id), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

#: CRC-32 of a word's bytes, with the table of the reflected polynomial.
CRC = """
steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS table_),
coded AS (SELECT t, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::int, 2))::bigint)),
lambda x, b: xor(x // 256, table_[(xor(x, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT t FROM words UNION SELECT DISTINCT t FROM wanted), steps)
"""

OP13 = f"""
WITH words AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, {TERMS} AS t FROM documents) GROUP BY ALL),
wanted AS (SELECT t, count(*) AS n FROM (SELECT {TERMS} AS t FROM benchmark) GROUP BY ALL),
{CRC.strip()},
source AS (SELECT bucket, sum(n)::bigint AS s FROM words JOIN coded USING (t) GROUP BY 1),
target AS (SELECT bucket, sum(n)::bigint AS t FROM wanted JOIN coded USING (t) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT sum(s) FROM source) + 10000)::double / ((s + 1)::double * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::double)))::bigint AS gain
FROM source LEFT JOIN target USING (bucket)),
weights AS (SELECT doc_id, sum(n)::bigint AS n_features, floor(sum(n * gain)::double / sum(n)::double)::bigint AS weight FROM words JOIN coded USING (t) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLE = {"op11_k2treap": OP11, "op13_resample": OP13}
