"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shared import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source, 64 to a directory; one that begins with a notice is a license file."""
    from larkspur.llm.licenses import CUE, scan

    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.concat("doc_id", F.lit(".txt")))
    docs = table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    return scan(docs, is_license_file=F.substring_index("text", "\n", 1).rlike(CUE))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vec_id divisible by 50 against all rows of ``embeddings``: the 5 nearest by cosine, through the graph index."""
    from larkspur.llm.ann import build_index, search

    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as pieces of sequences of 1024 ids."""
    import public_tokenizers

    from larkspur.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; links of at most 4 bits."""
    from larkspur.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all texts of ``documents``, their scores, and whether they decode to the text."""
    import public_tokenizers

    from larkspur.llm.unigram import encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, model, decode_to="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        "log_score",
        F.crc32("decoded").alias("decoded_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line of ``documents`` that is not blank: links of two edits from 24 characters on, equality below."""
    from larkspur.llm.lines import classes

    return classes(table(spark, sf_dir, "documents"), short=True)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from the folds that are not held out."""
    from larkspur.llm.langid import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2))
    return identify(docs, fold != 2).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of ``pages``, written to archives and read back by its index."""
    from larkspur.llm.warc import read, write

    index = write(table(spark, sf_dir, "pages"))
    return read(index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page of ``pages``."""
    from larkspur.llm.html import extract

    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vec_id divisible by 20 against all rows of ``embeddings``: the 20 highest integer inner products, exactly."""
    from larkspur.llm.topk import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_ann": op2_ann,
        "op3_packing": op3_packing,
        "op4_simhash": op4_simhash,
        "op5_unigram": op5_unigram,
        "op6_lines": op6_lines,
        "op7_langid": op7_langid,
        "op8_warc": op8_warc,
        "op9_html": op9_html,
        "op10_topk": op10_topk,
    }


OP1_SQL = r"""
WITH files AS (
  SELECT concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 64) AS BIGINT) AS VARCHAR), doc_id || '.txt') AS path, text,
    coalesce(regexp_matches(split_part(text, chr(10), 1), '{cue}'), false) AS is_file FROM documents),
units AS (
  SELECT DISTINCT path, unit FROM (
    SELECT path, unnest(string_split(text, chr(10))) AS unit, 0 AS kind FROM files
    UNION ALL SELECT path, unnest(string_split_regex(text, '\n[ \t\r]*\n')), 1 FROM files
    UNION ALL SELECT path, text, 2 FROM files WHERE is_file)
  WHERE kind = 2 OR (regexp_matches(unit, '{cue}') AND (kind = 0 OR contains(unit, chr(10))))),
marks AS (SELECT unit, count(*) AS n FROM units GROUP BY unit),
shelf(license, template) AS (VALUES {templates}),
own AS (SELECT unit, n, term, count(*) AS tf FROM (
  SELECT unit, n, unnest(regexp_extract_all(lower(unit), '{term}')) AS term FROM marks) GROUP BY ALL),
other AS (SELECT license, term, count(*) AS tf FROM (
  SELECT license, unnest(regexp_extract_all(lower(template), '{term}')) AS term FROM shelf) GROUP BY ALL),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM marks) + (SELECT count(*) FROM shelf) AS total),
idf AS (SELECT term, ln((1.0::DOUBLE + total) / (1.0::DOUBLE + sum(n))) + 1 AS idf FROM (
  SELECT term, n FROM own UNION ALL SELECT term, 1 FROM other), total GROUP BY term, total),
u AS (SELECT unit, term, tf * idf AS w FROM own JOIN idf USING (term)),
t AS (SELECT license, term, tf * idf AS v FROM other JOIN idf USING (term)),
un AS (SELECT unit, sqrt(sum(w * w)) AS wn FROM u GROUP BY unit),
tn AS (SELECT license, sqrt(sum(v * v)) AS vn FROM t GROUP BY license),
scored AS (SELECT unit, license, round(sum(w * v) / (any_value(wn) * any_value(vn)), 6) AS score
  FROM u JOIN t USING (term) JOIN un USING (unit) JOIN tn USING (license) GROUP BY unit, license),
fits AS (SELECT path, license, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS r
  FROM units JOIN scored USING (unit) WHERE score >= 0.7),
mine AS (SELECT path, license, score FROM fits WHERE r = 1),
dirs AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
covers AS (SELECT dir, path AS up_path, license AS up_license, score AS up_score FROM (
  SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS r
  FROM mine JOIN dirs USING (path) WHERE path IN (SELECT path FROM files WHERE is_file)) WHERE r = 1),
near AS (SELECT path, up_path, up_license, up_score, row_number() OVER (PARTITION BY path ORDER BY length(c.dir) DESC) AS r
  FROM dirs d JOIN covers c ON d.dir = c.dir OR starts_with(d.dir, c.dir || '/') OR c.dir = '')
SELECT f.path, coalesce(license, up_license) AS license, coalesce(score, up_score) AS score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN up_license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN license IS NOT NULL THEN f.path ELSE up_path END AS license_path
FROM files f LEFT JOIN mine USING (path) LEFT JOIN (SELECT * FROM near WHERE r = 1) USING (path)
"""
#: Base32 of a digest: groups of 20 bits (5 hex digits) become 4 characters.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
h AS (SELECT page_id, html, sha1(html) AS hex, first_id FROM p JOIN first USING (html))
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""
OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    from larkspur.llm.licenses import CUE, TEMPLATES, TERM

    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    return {
        "op1_licenses": OP1_SQL.replace("{cue}", CUE).replace("{term}", TERM).replace("{templates}", values),
        "op8_warc": OP8_SQL,
        "op10_topk": OP10_SQL,
    }
