"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import language, media, quality, toxicity
from casewright.llm.html import extract_main_text
from casewright.llm.jaccard import jaccard_components
from casewright.llm.kdtree import top_similar
from casewright.llm.language import id_remainder
from casewright.llm.mixing import mix_report
from casewright.llm.packing import pack_documents, pack_turns
from casewright.llm.simhash import simhash_components
from casewright.llm.tables import materialise, read_table
from casewright.llm.tokens import document_token_counts
from casewright.llm.trie import conversation_turns, prefix_trie, with_shared_openings
from casewright.llm.whitening import whiten


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_report(read_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a WAV medium, with checksums and a digest of its spectral-peak pairs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        media.wav_features(media.text_to_wav(text)).alias("f"),
    )
    named = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return found.select("doc_id", "n_bytes", *[F.col("f")[x].alias(x) for x in named], media.pair_digest(F.col("f")).alias("feature"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files by separator scan."""
    return document_token_counts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out from learning."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = language.fit_language_model(docs.where(~held_out))
    return language.predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack_documents(read_table(spark, sf_dir, "documents"), with_ids=False).select(*named)


def op5_instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all turns of conversations, in sequences bounded in tokens, pieces and loss-bearing tokens at once."""
    packed = pack_turns(read_table(spark, sf_dir, "conversations"))
    named = ["start", "length", "loss_tokens", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select("doc_id.conv_id", "doc_id.turn", *named)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = read_table(spark, sf_dir, "pages").select("page_id", "url", extract_main_text(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


#: Labels drawn, by a hash of the id, before they are joined with texts: a broadcast of about 1 MB at most.
LABEL_ROWS = 40_000


def _labelled(spark: SparkSession, sf_dir: str, learn, *more: str) -> DataFrame:
    """Labelled documents outside the held-out ids. The bounded draw of labels goes to the texts; no text is shuffled, and one
    scan finds them."""
    docs = read_table(spark, sf_dir, "documents").where(learn).select("doc_id", "text", *more)
    labels = read_table(spark, sf_dir, "labels").where(learn)
    drawn = language.bounded_sample(labels, [F.col(c) for c in labels.columns], LABEL_ROWS, 3)
    return materialise(docs.join(F.broadcast(drawn), "doc_id"), "labelled")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    return quality.fit_quality_model(_labelled(spark, sf_dir, id_remainder("doc_id", 5) != 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the documents is held out from learning."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    scored = quality.score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest inner products of every hundredth vector."""
    return top_similar(read_table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit_toxicity_model(_labelled(spark, sf_dir, id_remainder("doc_id", 3) != 1, "lang"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a third of the documents is held out from learning."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    scored = toxicity.score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of similar documents of every document."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that share their openings."""
    return prefix_trie(*with_shared_openings(conversation_turns(read_table(spark, sf_dir, "conversations"))))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 leading components, whitened."""
    return whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_entropy_mix,
        op2_media_columns,
        op3_separator_scan,
        op4_language,
        op5_vector_packing,
        op5_instruction_packing,
        op6_simhash_components,
        op7_main_text,
        op8_quality,
        op9_kdtree_topk,
        op10_toxicity,
        op11_jaccard_join,
        op12_prefix_trie,
        op13_embedding_whitening,
    )
}

ORACLE: dict[str, str] = {
    "op9_kdtree_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_jaccard_join": """
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT row_number() OVER () AS i, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS MATERIALIZED (
            SELECT i, doc_id, if(len(w) = 0, [], list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k:k + 4], ' ')))) AS s
            FROM d
        ), e AS MATERIALIZED (
            SELECT i, len(s) AS n, unnest(s) AS x FROM s
        ), links AS MATERIALIZED (
            SELECT a.i AS a, b.i AS b FROM e a JOIN e b ON a.x = b.x AND a.i <> b.i
            GROUP BY a.i, b.i, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach(i, j) AS (
            SELECT i, i FROM s UNION SELECT r.i, l.b FROM reach r JOIN links l ON l.a = r.j
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
        FROM s JOIN reach ON reach.i = s.i JOIN s t ON t.i = reach.j GROUP BY s.i, s.doc_id, s.s
    """,
    "op12_prefix_trie": """
        WITH own AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), bits AS (
            SELECT i, list_reduce([i] || range(8), lambda a, k: if(a % 2 = 1, xor(a // 2, 3988292384), a // 2)) AS v FROM range(256) t(i)
        ), crc_table AS (
            SELECT list(v ORDER BY i) AS t FROM bits
        ), heads AS (
            SELECT c, c - c % 20 AS base,
                   xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                       lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1])), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT c FROM own), crc_table
        ), taken AS (
            SELECT heads.c, own.r AS d, role, text FROM heads JOIN own ON own.c = heads.base AND own.r <= h
        ), n_taken AS (
            SELECT heads.c, h, (SELECT count(*) FROM taken WHERE taken.c = heads.c) AS n FROM heads
        ), turns AS (
            SELECT * FROM taken UNION ALL
            SELECT own.c, r - h + n, role, text FROM own JOIN n_taken ON own.c = n_taken.c AND r > h
        ), paths AS (
            SELECT c, d, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)) AS k,
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                   max(d) OVER (PARTITION BY c) AS n
            FROM turns
            UNION ALL SELECT c, 0, '', 0, coalesce((SELECT max(d) FROM turns WHERE turns.c = heads.c), 0) FROM heads
        ), nodes AS (
            SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
            FROM paths GROUP BY d, k
        ), named AS (
            SELECT nodes.*, up.conv_id AS parent_conv_id
            FROM nodes LEFT JOIN paths p ON p.c = nodes.conv_id AND p.d = nodes.d - 1
            LEFT JOIN nodes up ON up.d = p.d AND up.k = p.k
        ), kids AS (
            SELECT conv_id, d, (SELECT count(*) FROM named b WHERE b.parent_conv_id = a.conv_id AND b.d = a.d + 1) AS n_children FROM named a
        ), below AS (
            SELECT up.conv_id, up.d, count(*) FILTER (WHERE kids.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved
            FROM nodes x JOIN kids ON kids.conv_id = x.conv_id AND kids.d = x.d
            JOIN paths p ON p.c = x.conv_id AND p.d <= x.d JOIN nodes up ON up.d = p.d AND up.k = p.k
            GROUP BY ALL
        )
        SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
        FROM named JOIN kids USING (conv_id, d) JOIN below USING (conv_id, d)
    """,
}
