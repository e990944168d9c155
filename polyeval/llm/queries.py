"""Registered queries of this subpackage: name -> (builder, DuckDB SQL or None).

Every builder takes ``(spark, sf_dir)`` and applies its operator, with
production parameters, to the whole table. SQL is None where it cannot state
the operator or would be too slow on whole tables; ``tests/llm`` then holds the
query against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyeval.llm import (common, decontam, kdshards, lexical, licenses, minhash, pieces, quality, simhash, spelling,
                          substrings, toxicity, warc)
from polyeval.llm.common import table


SQL: dict[str, str] = {
    "op2_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT p.page_id, strlen(p.body) AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (body)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM s),
m AS (SELECT win, min(doc_id) AS least FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM k JOIN m USING (win) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
      FROM x LEFT JOIN g USING (doc_id, pos) WHERE g.pos IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op11_dual_tree_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d WHERE len(t) > 0),
c AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM f, g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM i JOIN c USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50""",
    # the checksum byte by byte (its table is built by the rule), near words by equal deletions
    "op12_spelling_variants": r"""
WITH RECURSIVE b AS (SELECT list(list_reduce(range(i, i + 1) || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(x) // 2),
    lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda s, v: xor(s >> 8, tab[(xor(s, v) & 255) + 1]))) AS h FROM c, b),
e AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word, n
      FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS p FROM w)),
k AS (SELECT a.word, z.word AS other FROM d a JOIN d z ON a.p = z.p AND a.rest = z.rest AND a.word <> z.word
      UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.rest),
m AS (SELECT k.word, count(*) AS n_near, first(k.other ORDER BY o.n DESC, k.other) AS best, max(o.n) AS best_n
      FROM k JOIN w o ON o.word = k.other GROUP BY k.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form,
        CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN m USING (word)),
t AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
      UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
l AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN l USING (word)""",
    "op13_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d),
k AS (SELECT g, min(doc_id) AS least FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT least, len(g) AS n, unnest(g) AS shingle FROM k),
e AS (SELECT a.least AS a, b.least AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.least <> b.least
        AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.least, a.n, b.least, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT least AS node, least AS seen FROM k UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node AND r.seen < e.b),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
  coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN k USING (g) LEFT JOIN c ON c.node = k.least""",
}


def piece_model() -> str:
    """Path of the production tokenizer."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    root = common.shared_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return kdshards.shard_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return pieces.token_report(table(spark, sf_dir, "documents"), piece_model()).drop("ids")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score_rules(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, machine)


def op10_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.fit_trees(docs, table(spark, sf_dir, "labels")))


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def load() -> dict:
    builders = (op1_benchmark_decontamination, op2_warc_archives, op3_simhash_near_dedup, op4_substring_dedup,
                op5_kd_shards, op6_license_scan, op7_sentencepiece, op8_rule_ensemble, op9_toxicity, op10_boosted_rules,
                op11_dual_tree_search, op12_spelling_variants, op13_minhash_near_dedup)
    return {b.__name__: (b, SQL.get(b.__name__)) for b in builders}
