"""Thin queries over the operators, with production parameters, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from . import cross_entropy, decontaminate, fingerprint, importance, jaccard_join, language, licenses, mixing, pieces, pii, quality, templates, whitening
from .common import table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), ids=False)


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cross_entropy.scores(docs, cross_entropy.fit(docs, table(spark, sf_dir, "labels"), contexts=16_384))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), n=3, percent=90).drop("class_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.segments(table(spark, sf_dir, "documents"))).drop("first_slot")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_language, op3_sentencepiece, op4_cross_entropy, op5_jaccard_join, op6_decontaminate, op7_fingerprint, op8_main_text, op9_license_scan, op10_quality, op11_whitening, op12_mixing, op13_importance)}

#: Trained scores, tokenizer ids, edit matching, keyed surrogates, trees of pages, ICU forms and
#: rules with look-ahead have no SQL twin; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op5_jaccard_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS g FROM words
), tokens AS (
    SELECT doc_id, len(g) AS n, unnest(g) AS t FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), pairs AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM reach c JOIN pairs p ON p.a = c.v WHERE c.root < p.b
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM sets s JOIN (SELECT v, min(root) AS component_id FROM reach GROUP BY v) c ON c.v = s.doc_id
""",
    # Taken words follow from a stream's place and its source's target; blocks and slots do not show.
    "op12_mixing": r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, ('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
    SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), c AS (
    SELECT *, sum(n) OVER () AS total, coalesce(sum(3 * n) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest FROM s WINDOW before AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
    SELECT coalesce(arg_min((total - capped) / rest, (n / w, source IS NULL, source)) FILTER ((total - capped) / rest * w <= 3 * n), max(3 * n / w)) AS level FROM c
), t AS (
    SELECT source, CAST(n AS BIGINT) AS n, least(CAST(3 * n AS DOUBLE), level * w) AS target FROM s, l
), p AS (
    SELECT d.*, t.n, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN n = 0 THEN 0 ELSE quota // n * size + greatest(0, least(size, quota % n - place)) END AS BIGINT) AS taken FROM p
""",
    # The CRC of each distinct n-gram is folded over its bytes.
    "op13_importance": r"""
WITH RECURSIVE crc AS (
    SELECT 0 AS k, i AS b, i AS v FROM range(256) r(i) UNION ALL SELECT k + 1, b, xor(v >> 1, 3988292384 * (v & 1)) FROM crc WHERE k < 8
), steps AS (
    SELECT list(v ORDER BY b) AS step FROM crc WHERE k = 8
), words AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS n, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
    UNION ALL
    SELECT 't', NULL, row_number() OVER (), list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark
), grams AS (
    SELECT side, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words
), per AS (
    SELECT side, n, g, count(*) AS c FROM grams GROUP BY ALL
), kinds AS (
    SELECT g, list_reduce([4294967295] || list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT), lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])) AS s FROM (SELECT DISTINCT g FROM per), steps
), buckets AS (
    SELECT g, xor(s, 4294967295) % 10000 AS b FROM kinds
), counts AS (
    SELECT b, sum(c) FILTER (side = 'd') AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t FROM per JOIN buckets USING (g) GROUP BY b
), totals AS (
    SELECT sum(s) AS s, sum(t) AS t FROM counts
), gains AS (
    SELECT b, CAST(floor(1000 * ln((coalesce(c.t, 0) + 1.0)::DOUBLE * (x.s + 10000)::DOUBLE / ((coalesce(c.s, 0) + 1.0)::DOUBLE * (x.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts c, totals x
), sums AS (
    SELECT n, sum(c) AS f, sum(c * gain) AS total FROM per JOIN buckets USING (g) JOIN gains USING (b) WHERE side = 'd' GROUP BY n
), scored AS (
    SELECT doc_id, len(w) AS words, CAST(coalesce(f, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % f) + f) % f) // f, 0) AS BIGINT) AS weight FROM words LEFT JOIN sums USING (n) WHERE side = 'd'
), noisy AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM scored
), ranked AS (
    SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS r, count(*) FILTER (words >= 20) OVER () AS eligible FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * eligible // 100 THEN r END AS rank FROM ranked
""",
}
