"""The registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers

from . import bpe, covertree, filteraudit, media, minhash, packing, quality, quotes, runs, secrets, sharding, templates, toxicity
from .common import table

VOCABULARY = "word_bpe_49k.json"


def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op4_cover_tree(spark, sf_dir):
    return covertree.near_links(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hilbert_shards(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark, sf_dir):
    words = secrets.whole_words(public_tokenizers.path(VOCABULARY))
    return secrets.scans(table(spark, sf_dir, "documents"), secrets.train(dictionary=words))


def op9_media(spark, sf_dir):
    return media.digests(table(spark, sf_dir, "documents"))


def op10_quotes(spark, sf_dir):
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op11_runs(spark, sf_dir):
    return runs.digests(table(spark, sf_dir, "documents"))


def op12_templates(spark, sf_dir):
    return templates.main_text(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark, sf_dir):
    return filteraudit.labelled_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_minhash, op4_cover_tree, op5_toxicity, op6_hilbert_shards, op7_quality, op8_secrets, op9_media, op10_quotes, op11_runs, op12_templates, op13_filter_audit)}

ORACLE_SQL = {
    "op3_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w
), n AS (SELECT doc_id, len(grams) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(grams) AS g FROM s),
rare AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.g IN (SELECT g FROM rare) GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * common >= 80 * (i.n_shingles + j.n_shingles - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT n.doc_id, n.n_shingles, min(reach.y) AS component_id, n.doc_id = min(reach.y) AS kept FROM n JOIN reach ON reach.x = n.doc_id GROUP BY n.doc_id, n.n_shingles""",
    "op4_cover_tree": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.x = vec_id""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
r AS (SELECT f.part, coalesce(l.q, 0) AS q, coalesce(l.x, 0) AS x, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS s, row_number() OVER () AS row_id FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
orders AS (SELECT '' AS o UNION ALL SELECT o || z FROM orders JOIN letters ON NOT contains(o, z)),
steps AS (SELECT o AS filter_order, unnest(range(1, 6))::INT AS step FROM orders WHERE length(o) = 5),
fails AS (SELECT row_id, part, q, x, z, CASE z WHEN 'A' THEN s.A WHEN 'B' THEN s.B WHEN 'C' THEN s.C WHEN 'D' THEN s.D ELSE s.E END AS bad FROM r, letters),
falls AS (SELECT row_id, part, q, x, list_sort(list(z) FILTER (bad)) AS failed FROM fails GROUP BY ALL),
kinds AS (SELECT part, coalesce(failed, []) AS failed, count(*) AS n, sum(q) AS q, sum(x) AS x FROM falls GROUP BY ALL),
gone AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS z, n, q, x, failed,
  (SELECT min(instr(filter_order, y)) FROM unnest(failed) AS u(y)) AS pos FROM kinds, steps),
out AS (SELECT part, filter_order, step, z, coalesce(sum(n) FILTER (pos IS NULL OR pos > step), 0) AS kept, coalesce(sum(n) FILTER (pos = step), 0) AS removed,
  coalesce(sum(n) FILTER (pos < step AND list_contains(failed, z)), 0) AS redundant, coalesce(sum(n) FILTER (failed = [z]), 0) AS unique_fails,
  coalesce(sum(q) FILTER (pos = step), 0) AS good_lost, coalesce(sum(x) FILTER (pos = step), 0) AS toxic_lost FROM gone GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, z)::BIGINT AS shapley FROM out""",
}
