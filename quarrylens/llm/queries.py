"""Registered queries of this subpackage, with their DuckDB cross-checks where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import (
    chat, context_mixing, decontaminate, exact_dedup, language_id, licenses, mixing, phrases, pii, repeats, simhash,
    token_shards, whitening)

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder)."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_language_id")
def op1(spark, folder):
    return language_id.language_report(_table(spark, folder, "documents"))


@query("op2_simhash_near_dedup")
def op2(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@query("op3_context_mixing")
def op3(spark, folder):
    return context_mixing.text_scores(_table(spark, folder, "documents"))


@query("op4_token_shards")
def op4(spark, folder):
    return token_shards.write_shards(_table(spark, folder, "documents"))


@query("op5_mixing")
def op5(spark, folder):
    return mixing.mix_plan(_table(spark, folder, "documents"))


@query("op6_exact_dedup", r"""
WITH normal AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)""")
def op6(spark, folder):
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontamination", f"""
WITH items AS (
    SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (
    SELECT r, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
    FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (r) LEFT JOIN found USING (r)""")
def op7(spark, folder):
    found = decontaminate.overlap_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("spans")


@query("op8_pii_anchors")
def op8(spark, folder):
    return pii.pii_report(_table(spark, folder, "documents"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` laid out as a tree ``source/4096s/256s/16s``: the first of each folder is its LICENSE file."""
    part = [F.floor(F.col("doc_id") / n).cast("string") for n in (4096, 256, 16)]
    folder = F.when(F.col("doc_id") % 4096 == 0, F.concat_ws("/", part[0], F.lit("LICENSE"))).when(
        F.col("doc_id") % 256 == 0, F.concat_ws("/", *part[:2], F.lit("LICENSE"))).when(
        F.col("doc_id") % 16 == 0, F.concat_ws("/", *part, F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", *part, F.concat("doc_id", F.lit(".txt"))))
    return docs.select("doc_id", folder.alias("path"), "text")


@query("op9_license_scan")
def op9(spark, folder):
    return licenses.scan_licenses(document_paths(_table(spark, folder, "documents")))


_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<', '\l'), '>', '\g')"


@query("op10_chat_format", rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(len('<turn role=>') + len({_ESCAPED.format('role')}) + len({_ESCAPED.format('text')}) + len('</turn>') + 2)
               AS chars
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars
FROM joined""")
def op10(spark, folder):
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_report(turns.unionByName(probe))


@query("op11_phrase_collocations", r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              """ + _LOWER.format("coalesce(text, '')") + r""", '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
found AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
longer AS (
    SELECT lang, g, max(a) AS most
    FROM (SELECT lang, w[1] || ' ' || w[2] AS g, a FROM found WHERE k = 3
          UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM found WHERE k = 3) GROUP BY ALL),
kept AS (
    SELECT found.* FROM found LEFT JOIN longer ON found.lang = longer.lang AND found.g = longer.g AND found.k = 2
    WHERE most IS NULL OR 100 * most < 50 * a),
cuts AS (
    SELECT lang, g, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
    FROM kept, (VALUES (1), (2)) AS cs(c) WHERE c < k),
scored AS (
    SELECT cuts.*, h.f AS l, t.f AS r, (1000000 * a::HUGEINT * a // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts JOIN f AS h ON h.lang = cuts.lang AND h.g = head AND h.k = c
    JOIN f AS t ON t.lang = cuts.lang AND t.g = tail AND t.k = len(string_split(cuts.g, ' ')) - c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op11(spark, folder):
    return phrases.collocations(_table(spark, folder, "documents"))


@query("op12_embedding_whitening")
def op12(spark, folder):
    found = whitening.whiten(_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op13_substring_dedup", r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
repeated AS (
    SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM windows) WHERE doc_id > low),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM repeated),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS said FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""")
def op13(spark, folder):
    return repeats.repeat_report(_table(spark, folder, "documents")).drop("repeats")
