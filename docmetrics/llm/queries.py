"""The queries op1 to op13 and the pipeline: thin callers of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import wordbpe
from .bytebpe import round_trip_digests
from .collocations import collocations
from .embeddings import near_duplicate_vectors
from .exactdedup import exact_duplicates
from .minhash import near_duplicates
from .packing import pack_documents
from .periodicity import periodic_runs, planted, run_digests
from .pii import find_personal_data
from .suffixdedup import remove_repeats
from .toxicity import toxicity
from .urlfilter import filter_urls
from .warczip import archive_round_trip

#: Rules of op3: host, path prefix, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base patterns' spans, and all spans with those that the trees add."""
    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2,048 tokens, and their place in a sequence."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without bytes of 200-byte strings that start anywhere else too."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=200, with_text=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every text and their decoding, as digests."""
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels of rows that are not held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of ZIP-packaged archives, written and read back."""
    return archive_round_trip(spark, table(spark, sf_dir, "pages"), least=0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text's words, in one of ten texts after a stretch is repeated; nulls count as empty, null ids repeat nothing."""
    docs = table(spark, sf_dir, "documents")
    return run_digests(periodic_runs(docs.select("doc_id", planted().alias("text"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by score."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level ids of every text and their decoding, as digests."""
    import public_tokenizers

    return wordbpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_warc_zip": op10_warc_zip,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_word_bpe": op13_word_bpe,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_url_filter": """
        WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
             h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
             m AS (SELECT page_id, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
                   FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
        SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1""",
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op12_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
             grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k)),
             f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
             n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
             c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
             cuts AS (SELECT c.lang, c.k, c.phrase, a, j, l.f AS l, r.f AS r, (2000000 * a::HUGEINT // (l.f + r.f))::BIGINT AS score
                      FROM c, (VALUES (1), (2), (3)) AS places(j)
                      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ')
                      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ')
                      WHERE j < c.k),
             best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
             held AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM c, (VALUES (2), (3)) AS sizes(m), (VALUES (1), (2), (3)) AS starts(s) WHERE m < k AND s + m - 1 <= k) GROUP BY ALL),
             free AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM free JOIN n USING (lang) QUALIFY rank <= 2000""",
}
