"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
#: lower() would also change letters outside A-Z.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN k ON k.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def _seeded(parts: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {parts}), 1, 8))::BIGINT"


_before = "(({b} + f) * rest // blocks - f * rest // blocks)".format

OP10 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-') AS known FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
wt AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM per),
lv AS (SELECT *, (sum(ss) OVER () * 1.5::DOUBLE - coalesce(sum(ss) OVER q, 0) * 2.0::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0.0::DOUBLE)) AS level
  FROM wt WINDOW q AS (ORDER BY ss::DOUBLE / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT level AS water FROM lv WHERE level * w <= ss * 2.0::DOUBLE ORDER BY ss::DOUBLE / w, nth LIMIT 1),
aim AS (SELECT source, ss, coalesce(least((SELECT water FROM fit) * w, ss * 2.0::DOUBLE), ss * 2.0::DOUBLE) AS target FROM wt),
ns AS (SELECT greatest(1, ceil(count(*) / 1000.0)::BIGINT) AS shards FROM d),
lines AS (SELECT source, shards, greatest(1, least(shards, ss // 4096))::BIGINT AS own, {_seeded("coalesce(source, '-')", 45)} % shards AS first FROM aim, ns),
dealt AS (SELECT d.*, ((({_seeded("known", 42)} % own) * shards // own) + first) % shards AS shard FROM d JOIN lines ON d.source IS NOT DISTINCT FROM lines.source),
ln AS (SELECT shard, source, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL HAVING sum(size) > 0),
sh AS (SELECT ln.*, target * words / ss AS share, ceil(words / blk)::BIGINT AS blocks, blk::BIGINT AS block FROM ln JOIN aim ON ln.source IS NOT DISTINCT FROM aim.source
  JOIN (SELECT shard, CASE WHEN min(words) >= 64 THEN 2.0 ** floor(least(6, log2(min(words) / 64.0))) ELSE 1.0 END AS blk FROM ln GROUP BY shard) USING (shard)),
seats AS (SELECT shard, round(sum(share) / any_value(block)) AS seats FROM sh GROUP BY shard),
quot AS (SELECT shard, source, row_number() OVER (PARTITION BY shard ORDER BY share / block / (2 * k + 1) DESC, source NULLS LAST, k) AS rank FROM sh, unnest(range(0, 2 * blocks + 64)) AS t(k)),
won AS (SELECT shard, source, count(*) AS n FROM quot JOIN seats USING (shard) WHERE rank <= seats GROUP BY ALL),
quota AS (SELECT sh.shard, sh.source, blocks, block, least(coalesce(n, 0), 2 * blocks)::BIGINT AS quota FROM sh LEFT JOIN won ON won.shard = sh.shard AND won.source IS NOT DISTINCT FROM sh.source),
pos AS (SELECT *, sum(size) OVER (PARTITION BY shard, source ORDER BY {_seeded("known", 43)}, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM dealt),
drawn AS (SELECT pos.*, coalesce(blocks, 1) AS blocks, coalesce(block, 1) AS block, coalesce(quota, 0) // coalesce(blocks, 1) AS passes, coalesce(quota, 0) % coalesce(blocks, 1) AS rest,
    {_seeded("pos.shard::VARCHAR || ':' || coalesce(pos.source, '-')", 44)} % coalesce(blocks, 1) AS f, start // coalesce(block, 1) AS b1, (start + size - 1) // coalesce(block, 1) AS b2
  FROM pos LEFT JOIN quota ON quota.shard = pos.shard AND quota.source IS NOT DISTINCT FROM pos.source)
SELECT doc_id, size, aim.ss AS source_size, target, (passes * size + CASE WHEN size > 0 THEN
    ({_before(b="(b2 + 1)")} - {_before(b="b1")}) * block
    - ({_before(b="(b1 + 1)")} - {_before(b="b1")}) * (start - b1 * block)
    - ({_before(b="(b2 + 1)")} - {_before(b="b2")}) * ((b2 + 1) * block - start - size) ELSE 0 END)::BIGINT AS taken
FROM drawn JOIN aim ON drawn.source IS NOT DISTINCT FROM aim.source
"""


def oracle_sql() -> dict:
    return {"op5_near_duplicates": OP5, "op10_mixing": OP10}
