"""The queries over documents and embeddings, with the SQL of those that SQL can express. Those over tokens and turns are beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import embedding_links, language_id, licenses, line_templates, mixing, pieces, secret_lexing, shingle_join, syncmers, toxicity
from palisade.llm import conversation_queries, token_queries  # noqa: F401 - they register their queries
from palisade.llm.registry import ORACLE, SPARK, query  # noqa: F401 - the driver contract reads them here
from palisade.llm.tables import id_remainder, table


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
        F.col("toxicity_threshold").alias("threshold"), F.col("toxicity_rejected").alias("rejected"))


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.array_sort(F.array_distinct(F.transform("license_base", lambda x: x["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("license_base", lambda x: x["label"]), F.transform("license_spans", lambda x: x["label"]))))
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size("license_base").cast("long").alias("n_base"),
        F.array_min(F.transform("license_base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("license_base", lambda x: x["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.col("license_score").alias("score"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    model = language_id.fit_languages(docs, ~held_out)
    found = language_id.identify_languages(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def _is(kind: str):
    return lambda x: x == kind


def _joined(spans, kinds: tuple[str, ...]):
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_lexing.secret_scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = {k: F.size(F.filter(F.transform("secret_spans", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in secret_lexing.KINDS}
    return found.select(
        "doc_id", count["assign"], count["access"], count["hex"],
        F.sha2(_joined("secret_spans", secret_lexing.KINDS[:3]), 256).alias("base_sha256"),
        _joined("secret_spans", secret_lexing.KINDS).alias("spans"), count["literal"],
        F.coalesce(F.array_max(F.transform("secret_spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


@query("op9_embedding_links", sql="""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(l.y, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.x = e.vec_id LEFT JOIN least l ON l.x = e.vec_id
""")
def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.embedding_links(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query("op8_shingle_components", sql="""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
           ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id
""")
def op8_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(table(spark, sf_dir, "documents"))


@query("op1_mix_sources", sql="""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce('s' || source, 'n') AS name, coalesce(length(text), 0) AS chars, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
sizes AS (SELECT name, greatest(CAST(floor(sqrt(CAST(sum(chars) AS DOUBLE))) AS BIGINT), 1) AS w FROM d GROUP BY name),
shares AS (
    SELECT name, row_number() OVER (ORDER BY name) AS i,
           greatest(CAST((1000 * w + sum(w) OVER ()) // (2 * sum(w) OVER ()) AS BIGINT), 1) AS share FROM sizes),
listed AS (SELECT list(share ORDER BY i) AS shares, CAST(sum(share) AS BIGINT) AS period FROM shares),
edf AS (
    SELECT CAST(-1 AS BIGINT) AS t, list_transform(shares, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM listed
    UNION ALL
    SELECT t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = next % 100000 THEN 1 ELSE 0 END), next % 100000
    FROM (SELECT t, done, list_min(list_transform(
              list_filter(range(1, len(done) + 1), lambda i: done[i] < shares[i] AND (done[i] * period) // shares[i] <= t + 1),
              lambda i: (((done[i] + 1) * period + shares[i] - 1) // shares[i]) * 100000 + i)) AS next
          FROM edf, listed WHERE t + 1 < period)),
slots AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf WHERE t >= 0),
placed AS (
    SELECT *, (coalesce(sum(chars) OVER (PARTITION BY name ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS mix_offset FROM d),
blocks AS (SELECT *, CAST(mix_offset AS BIGINT) // 65536 AS mix_block FROM placed)
SELECT b.doc_id, b.source, CAST(b.mix_offset AS BIGINT) AS mix_offset, b.mix_block,
       (b.mix_block // s.share) * l.period + (x.turn * l.period) // s.share AS mix_release,
       (b.mix_block // s.share) * l.period + ((x.turn + 1) * l.period + s.share - 1) // s.share AS mix_deadline,
       (b.mix_block // s.share) * l.period + x.slot AS mix_slot
FROM blocks b JOIN shares s ON s.name = b.name JOIN slots x ON x.i = s.i AND x.turn = b.mix_block % s.share, listed l
""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", *mixing.ADDED)


@query("op3_line_templates", sql=r"""
WITH d AS (SELECT doc_id, text, md5(text) AS th, string_split(text, chr(10)) AS parts FROM documents),
l AS (
    SELECT doc_id, th, pos, string_split_regex(regexp_replace(regexp_replace(parts[pos], '[^ \t\r\f]*[0-9][^ \t\r\f]*', '<*>', 'g'),
           '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g'), '[ \t\r\f]+') AS tokens
    FROM (SELECT doc_id, th, parts, unnest(range(1, len(parts) + 1)) AS pos FROM d)),
lines AS (SELECT *, len(tokens) AS n, array_to_string(tokens[1:3], ' ') AS head, array_to_string(tokens, ' ') AS masked FROM l WHERE len(tokens) >= 4),
mixed AS (SELECT n, head FROM lines GROUP BY n, head HAVING min(masked) < max(masked) AND min((doc_id, th)) < max((doc_id, th))),
uniq AS (SELECT n, head, masked, any_value(tokens) AS tokens, count(*) AS c FROM lines SEMI JOIN mixed USING (n, head) GROUP BY n, head, masked),
total AS (SELECT n, head, sum(c) AS total_lines FROM uniq GROUP BY n, head),
tok AS (SELECT n, head, masked, c, unnest(range(1, n + 1)) AS i, unnest(tokens) AS t FROM uniq),
constant AS (
    SELECT n, head, i, t FROM (SELECT n, head, i, t, sum(c) AS has FROM tok GROUP BY n, head, i, t) JOIN total USING (n, head)
    WHERE has >= 2 AND has >= total_lines * CAST(0.2 AS DOUBLE)),
kept AS (SELECT n, head, masked, count(*) AS k, string_agg(i || ':' || t, ' ' ORDER BY i) AS kept FROM tok SEMI JOIN constant USING (n, head, i, t) GROUP BY n, head, masked),
templates AS (SELECT masked, n || '/' || head || '/' || kept AS template FROM kept WHERE k >= n * CAST(0.6 AS DOUBLE)),
keyed AS (SELECT doc_id, th, pos, coalesce(template, 'exact ' || masked) AS template FROM lines LEFT JOIN templates USING (masked)),
recurring AS (SELECT template, min(doc_id * 1000000 + pos) AS place FROM keyed GROUP BY template HAVING min((doc_id, th)) < max((doc_id, th))),
gone AS (SELECT doc_id, pos FROM keyed JOIN recurring USING (template) WHERE doc_id * 1000000 + pos <> place),
cut AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.parts), 0) AS n_lines, coalesce(len(c.ats), 0) AS n_dropped,
       md5(CASE WHEN c.ats IS NULL THEN d.text
           ELSE array_to_string(list_transform(list_filter(range(1, len(d.parts) + 1), lambda i: NOT list_contains(c.ats, i)), lambda i: d.parts[i]), chr(10)) END) AS kept_md5
FROM d LEFT JOIN cut c USING (doc_id)
""")
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query("op4_sentence_pieces")
def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load_vocabulary()
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    encoded = pieces.encode_pieces(docs, vocabulary, keep=["doc_id", "text"])
    decoded = pieces.decode_pieces(encoded, vocabulary)
    return decoded.select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_pieces", F.xxhash64("piece_ids").alias("ids_hash"),
                          (F.col("decoded") == F.col("text")).alias("round_trip"))


@query("op5_syncmers")
def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))
