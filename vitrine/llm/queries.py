"""One query per operator, over its whole table; ``ORACLES`` where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (bm25_decontam, bwt_dedup, collocations, cover_tree, langid_bigru, line_chunks, packing, quality_pu, sentencepiece_offsets,
                         simhash_trie, token_alignment, toxicity_fm, url_rules)
from vitrine.llm.common import crc_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOXIC_FROM = 0.7
GOOD_FROM = 0.3


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return register


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity_fm.FactorizationMachine:
    """Fitted on the labelled documents outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1)
    return toxicity_fm.train(table(spark, sf_dir, "documents"), labels)


@query()
def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity_fm.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"))


# Chunks between marked lines, and short chunks under each rule: every repeat but the first goes.
_OP2_ORACLE = f"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), hashed AS (
  SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {line_chunks.PRIME}) AS h FROM lines
), rolled AS (
  SELECT doc_id, l, list_transform(range(1, len(h) + 1), lambda i:
    (h[i] + coalesce(CASE WHEN i > 1 THEN h[i - 1] END * {line_chunks.BASE} % {line_chunks.PRIME}, 0)) % {line_chunks.PRIME}) AS r FROM hashed
), ends AS (
  SELECT doc_id, l, list_append(list_filter(range(1, len(l) + 1), lambda i:
    i >= 2 AND i <= len(l) - 2 AND r[i] % {line_chunks.DIVISOR} = 0 AND r[i - 1] % {line_chunks.DIVISOR} <> 0), len(l)) AS e FROM rolled
), spans AS (
  SELECT doc_id, l, unnest(list_transform(range(1, len(e) + 1), lambda k:
    {{'a': CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END, 'b': e[k]}})) AS s FROM ends
), opened AS (
  SELECT doc_id, l, r, a, k FROM (SELECT doc_id, l, r, unnest(range(1, len(l))) AS a FROM rolled), (SELECT unnest(range(0, {line_chunks.RULES})) AS k)
  WHERE r[a + 1] & (1::BIGINT << k) <> 0
), short AS (
  SELECT doc_id, l, a, list_filter(range(a + 1, least(len(l), a + {line_chunks.REACH - 1}) + 1), lambda j: r[j] & (1::BIGINT << (k + 15)) <> 0)[1] AS b FROM opened
), chunks AS (
  SELECT DISTINCT doc_id, a, b, array_to_string(l[a:b], chr(10)) AS chunk FROM (
    SELECT doc_id, l, s.a AS a, s.b AS b FROM spans UNION ALL SELECT doc_id, l, a, b FROM short) WHERE b > a
), gone AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS r FROM chunks) WHERE r > 1
), per_doc AS (
  SELECT doc_id, list(DISTINCT k) AS g FROM (SELECT doc_id, unnest(range(a, b + 1)) AS k FROM gone) GROUP BY doc_id
)
SELECT d.doc_id, len(d.l)::BIGINT AS lines_before, coalesce(len(g), 0)::BIGINT AS lines_removed,
  sha256(array_to_string(list_filter(d.l, lambda x, i: g IS NULL OR NOT list_contains(g, i)), chr(10))) AS kept_sha256
FROM lines d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""


@query(_OP2_ORACLE)
def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    out = line_chunks.dedup_lines(table(spark, sf_dir, "documents"), rules=line_chunks.RULES)
    return out.select("doc_id", "lines_before", "lines_removed",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_OP2_PASSAGES_ORACLE = """
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), pairs AS (
  SELECT doc_id, i, l[i] || chr(10) || l[i + 1] AS pair FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM lines)
), gone AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) AS r FROM pairs) WHERE r > 1
), per_doc AS (
  SELECT doc_id, list(DISTINCT k) AS g FROM (SELECT doc_id, unnest([i, i + 1]) AS k FROM gone) GROUP BY doc_id
)
SELECT d.doc_id, len(d.l)::BIGINT AS lines_before, coalesce(len(g), 0)::BIGINT AS lines_removed,
  sha256(array_to_string(list_filter(d.l, lambda x, i: g IS NULL OR NOT list_contains(g, i)), chr(10))) AS kept_sha256
FROM lines d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""


@query(_OP2_PASSAGES_ORACLE)
def op2_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document when every repeated passage of two lines or more goes."""
    out = line_chunks.dedup_lines(table(spark, sf_dir, "documents"), every_pair=True)
    return out.select("doc_id", "lines_before", "lines_removed",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query()
def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from trusted positives and unlabelled texts outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    learn = crc_fold("doc_id", 5) != 0
    good = table(spark, sf_dir, "labels").where(learn & (F.col("quality") == 1))
    model = quality_pu.train(docs.where(learn), good)
    return quality_pu.score(docs, model).select(
        "doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"))


_OP4_ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {cover_tree.MIN_COSINE}
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u
), comp AS (SELECT u, min(w) AS c FROM reach GROUP BY u
), counted AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN comp ON vec_id = comp.u LEFT JOIN counted ON vec_id = counted.u
"""


@query(_OP4_ORACLE)
def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every embedding."""
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op5_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them; ``span_bytes`` is what the pieces' spans cover."""
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256", "span_bytes")
    return sentencepiece_offsets.encode(table(spark, sf_dir, "documents"), tokenizer_path(), outputs=wanted).select("doc_id", *wanted)


# Bytes as two hex digits each; a text's strings of LENGTH bytes start at every second digit.
_OP6_ORACLE = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT doc_id, unnest(range(0, greatest(0, len(x) // 2 - {bwt_dedup.LENGTH - 1}))) AS p, x FROM d
), g AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, {2 * bwt_dedup.LENGTH}) AS t FROM s
), f AS (
  SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT g.doc_id, p FROM g JOIN f ON g.t = f.t WHERE g.doc_id > f.first
), opens AS (
  SELECT doc_id, p, p > coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {bwt_dedup.LENGTH}, -1) AS o FROM gone
), runs AS (
  SELECT doc_id, p, sum(o::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM opens
), spans AS (
  SELECT doc_id, r, min(p) AS a, max(p) + {bwt_dedup.LENGTH} AS b FROM runs GROUP BY doc_id, r
), per_doc AS (
  SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY a) AS l, sum(b - a)::BIGINT AS n, count(*)::BIGINT AS k FROM spans GROUP BY doc_id
)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN l IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(l) + 2), lambda i:
    substr(x, 2 * CASE WHEN i > 1 THEN l[i - 1].b ELSE 0 END + 1, 2 * (CASE WHEN i <= len(l) THEN l[i].a ELSE len(x) // 2 END - CASE WHEN i > 1 THEN l[i - 1].b ELSE 0 END))), '') END)) AS kept_sha256
FROM d LEFT JOIN per_doc USING (doc_id)
"""


@query(_OP6_ORACLE)
def op6_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of repeated 50-byte strings leaves of every document."""
    out = bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op7_bm25_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return bm25_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_langid_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid_bigru.train(docs.where(crc_fold("doc_id", 3) != 1))
    return langid_bigru.predict(docs, model).select(
        "doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query()
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_rules.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest doc_id of its component."""
    found = simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op11_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, and how common its links are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.alignment(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# Every n-gram spread out by itself; words hold no space, so a phrase's words are its parts at spaces.
_OP12_ORACLE = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
    'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' '), chr(10))) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(1, len(ws) - k + 2)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= {collocations.MIN_COUNT}
), cuts AS (
  SELECT c.*, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f * t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
), low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, a AS longer, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3
), most AS (
  SELECT lang, phrase, max(longer) AS m FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT low.* FROM low LEFT JOIN most USING (lang, phrase) WHERE m IS NULL OR 100 * m < {collocations.WITHIN} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}
"""


@query(_OP12_ORACLE)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


@query()
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence."""
    found, id_type = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids"), id_type).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
