"""The queries of these operators over the whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import decontaminate, jaccard, licenses, line_dedup, lm, mixing, quality, tiff, warc, wavelet
from gossamer.llm._store import new_path, written
from gossamer.llm.license_texts import TEMPLATES

#: Weights of the mixture; what is not named weighs 1.
WEIGHTS: dict[str, dict[str | None, int]] = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 3}, "source": {"src0": 2}}


def domain():
    """The tables have no domain: sources are dealt to three by their number."""
    return F.concat(F.lit("d"), F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 3").cast("string"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), TEMPLATES)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id"]).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet.write(table(spark, sf_dir, "documents"), tokenizer_path(), new_path(spark, "wavelet"))
    crc = F.crc32("ids").alias("ids_crc32")
    return wavelet.read(manifest).select("doc_id", "start", "n_tokens", crc)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    indexed = warc.index(warc.write(table(spark, sf_dir, "pages"), folder), folder)
    return warc.records(indexed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), domain(), WEIGHTS, share=0.5, most_epochs=2, seed=1).drop("__row")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    stored = written(tiff.with_media(docs).select("doc_id", "n_bytes", "media"), "tiff")
    return tiff.digests(stored)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, encoded = lm.train(docs)
    return lm.score(encoded, model)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: the finds that hold a whole template, word for word."""
    found = op1_licenses(spark, sf_dir).where("n_matched = n_words")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    span = F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))
    whole = F.regexp_count(span, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")) == F.col("n_words")
    return found.join(texts, F.col("doc_id") == F.col("id")).where(whole).select("doc_id", "license").distinct()


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: every document scored once, in its fold, and predicted as its score says."""
    scored = op2_quality(spark, sf_dir)
    return scored.select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"), ((F.col("score") >= 0.3).cast("int") == F.col("predicted")).alias("as_scored"))


def tiff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: the payloads that are read back."""
    return op8_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: counts and base scores, and that the model's probabilities are at most 1."""
    return op9_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"), (F.col("score") <= 0).alias("at_most_one"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_wavelet": op4_wavelet,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_jaccard": op7_jaccard,
    "op8_tiff": op8_tiff,
    "op9_lm": op9_lm,
    "op10_decontaminate": op10_decontaminate,
    "pipeline": pipeline,
    "license_notices": license_notices,
    "quality_folds": quality_folds,
    "tiff_payloads": tiff_payloads,
    "lm_base_scores": lm_base_scores,
}

ORACLE: dict[str, str] = {}

#: Words of a text as they are compared, between single spaces.
_PLAIN = r"' ' || array_to_string(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+'), ' ') || ' '"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE["license_notices"] = f"""
WITH t AS ({" UNION ALL ".join(f"SELECT {_quoted(n)} AS license, {_PLAIN.format(_quoted(x))} AS w" for n, x in TEMPLATES.items())}),
d AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, license FROM d JOIN t ON contains(d.w, t.w)
"""

#: crc32 of a doc_id's text as c, by the table of the polynomial 0xEDB88320.
CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""

ORACLE["quality_folds"] = f"WITH {CRC} SELECT d.doc_id, coalesce(c % 5 = 0, false) AS held_out, true AS in_range, true AS as_scored FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id"

ORACLE["tiff_payloads"] = r"""
SELECT doc_id, n AS n_bytes, n + z AS payload_bytes, sha256(encode(coalesce(text, '')) || unhex(repeat('00', z::INT))) AS payload_sha256
FROM (SELECT *, CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END AS z FROM (SELECT doc_id, text, strlen(coalesce(text, ''))::BIGINT AS n FROM documents))
"""

ORACLE["lm_base_scores"] = rf"""
WITH {CRC},
w AS (
  SELECT row_number() OVER () AS r, d.doc_id, coalesce(c % 7 = 2, false) AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ' ') AS w
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
t AS (SELECT r, held_out, unnest(w) AS x FROM w),
counts AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS v FROM counts),
sums AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (total + v + 1)::DOUBLE)) AS base
  FROM t LEFT JOIN counts USING (x), n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, round(base, 4) AS base_score, true AS at_most_one FROM sums JOIN w USING (r), n
"""

#: Lines of a document, their keys, and which of them go.
ORACLE["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(shared.largest <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op10_decontaminate"] = r"""
WITH w AS (
  SELECT 0 AS item, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') FROM benchmark),
lengths AS (SELECT DISTINCT least(5, len(w)) AS n FROM w WHERE item = 1 AND len(w) > 0),
items AS (
  SELECT DISTINCT id AS item_id, least(5, len(w)) AS n, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE item = 1 AND len(w) > 0),
docs AS (
  SELECT DISTINCT id AS doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM w, lengths, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE item = 0 AND len(w) >= n),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, count(*)::INTEGER AS n_found, count(*) / n_shingles::DOUBLE AS containment
FROM docs JOIN items USING (n, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""

ORACLE["op5_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (
  SELECT *, CAST(unhex(sha) AS BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT
      + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM b
"""

ORACLE["op7_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(4, len(w)) - 1], ' ')) AS s
  FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id,
       coalesce((SELECT count(*) FROM links WHERE links.a = d.doc_id), 0)::BIGINT AS n_links
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _budget_level(name: str, above: list[str], parent: str, weights: str) -> str:
    """SQL of the budgets one level down: children fill up in order of capacity per weight, the rest goes by weight."""
    by = f"PARTITION BY {', '.join(above)}" if above else ""
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in above) or "true"
    here = ", ".join([*above, name])
    return f"""
b_{name}_n AS (SELECT {here}, sum(tokens) * 2 AS cap, {weights} AS w FROM leaves GROUP BY {here}),
b_{name}_a AS (SELECT n.*, p.budget FROM b_{name}_n n JOIN {parent} p ON {same}),
b_{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  coalesce(sum(w) OVER ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0, sum(w) OVER ({by}) AS w1 FROM b_{name}_a),
b_{name}_c AS (SELECT *, cap * (w1 - w0) <= w * (budget - c0) AS is_full FROM b_{name}_b),
b_{name}_d AS (SELECT *, greatest(budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0), 0)::HUGEINT AS rest,
  sum(w) FILTER (WHERE NOT is_full) OVER ({by})::HUGEINT AS w2 FROM b_{name}_c),
b_{name}_e AS (SELECT *, CASE WHEN NOT is_full THEN rest * w // w2 END AS part, CASE WHEN NOT is_full THEN rest * w % w2 END AS over FROM b_{name}_d),
b_{name} AS (SELECT {here}, CASE WHEN is_full THEN cap ELSE part + CASE WHEN row_number() OVER ({by} ORDER BY over DESC NULLS LAST, {name} NULLS FIRST)
  <= rest - coalesce(sum(part) OVER ({by}), 0) THEN 1 ELSE 0 END END::HUGEINT AS budget FROM b_{name}_e)"""


def _weights(level: str) -> str:
    return f"CASE {level} {' '.join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())} ELSE 1 END"


ORACLE["op6_mixing"] = rf"""
WITH rows_ AS (
  SELECT doc_id, 'd' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows_ GROUP BY ALL),
b_all AS (SELECT least(floor(sum(tokens) * 0.5), sum(tokens) * 2)::HUGEINT AS budget FROM leaves),
{_budget_level("domain", [], "b_all", _weights("domain"))},
{_budget_level("lang", ["domain"], "b_domain", _weights("lang"))},
{_budget_level("source", ["domain", "lang"], "b_lang", _weights("source"))},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget FROM leaves l JOIN b_source b
  ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
placed AS (SELECT r.*, epochs, budget - epochs * tokens AS rest,
  sum(n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY md5('1:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')))
    - sum(n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source, md5('1:' || epochs || ':' || coalesce(doc_id::VARCHAR, ''))) AS before
  FROM rows_ r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed WHERE epochs + CASE WHEN before < rest THEN 1 ELSE 0 END > 0
"""
