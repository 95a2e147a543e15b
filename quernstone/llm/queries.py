"""The registered queries over the standard tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quernstone.llm._env import scratch
from quernstone.llm.bpe import bpe_decode, bpe_encode
from quernstone.llm.chat_format import format_chats, read_chats
from quernstone.llm.decontaminate import find_leaks
from quernstone.llm.embedding_dedup import embedding_links
from quernstone.llm.language_id import language_id
from quernstone.llm.language_id import train as language_id_model
from quernstone.llm.license_scan import license_scan
from quernstone.llm.license_scan import oracle as license_oracle
from quernstone.llm.ngram_join import jaccard_components
from quernstone.llm.substring_dedup import substring_dedup
from quernstone.llm.token_files import read_token_files, write_token_files
from quernstone.llm.toxicity import held_out, toxicity_scores, train


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{text}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{text}'")
    chats = read_chats(format_chats(rows.unionByName(more)))
    parts = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(parts, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op3_bpe(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark, sf_dir):
    folder = scratch(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_embedding_dedup(spark, sf_dir):
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op6_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = language_id_model(docs.filter(held_out("doc_id", 3) != 1))
    out = language_id(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (held_out("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark, sf_dir):
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(held_out("doc_id", 5) != 0))
    scored = toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (held_out("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_license_scan(spark, sf_dir):
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents")).drop("kept")


SQL1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(a[p:p+4], ' ')) AS k FROM w, unnest(range(1, greatest(len(a) - 3, 2))) AS t(p) WHERE len(a) > 0),
s AS (SELECT doc_id, count(*) AS n, sum(k) AS f1, bit_xor(k) AS f2 FROM g GROUP BY doc_id),
c AS (SELECT n, f1, f2, min(doc_id) AS rep FROM s GROUP BY ALL),
r AS (SELECT g.doc_id, g.k, c.n FROM g JOIN c ON g.doc_id = c.rep),
df AS (SELECT k FROM r GROUP BY k HAVING count(*) > 1),
q AS (SELECT r.* FROM r SEMI JOIN df ON r.k = df.k),
q2 AS (SELECT * FROM q WHERE doc_id IN (SELECT doc_id FROM q GROUP BY doc_id, n HAVING 100 * count(*) >= 75 * n)),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM q2 x JOIN q2 y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
p(a, b) AS (SELECT rep, rep FROM c UNION SELECT p.a, l.b FROM p JOIN l ON l.a = p.b),
m AS (SELECT a AS rep, min(b) AS m FROM p GROUP BY a)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.m, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.n = s.n AND c.f1 = s.f1 AND c.f2 = s.f2 LEFT JOIN m ON m.rep = c.rep"""

SQL2 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, text || CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE role END AS x FROM t),
n AS (SELECT *, length(x) + length(x) - length(replace(x, '\', '')) + list_sum([(length(x) - length(replace(x, c, ''))) // length(c) for c in ['[SYS]', '[/SYS]', '[INST]', '[/INST]', '<s>', '</s>', '[ROLE]', '[/ROLE]', '[:]']])
+ CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 END AS chars FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM n)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END)
AND arg_max(role, i) = 'assistant' AS valid
FROM o GROUP BY conv_id"""

SQL5 = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
p(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.a, l.b FROM p JOIN l ON l.a = p.b),
m AS (SELECT a AS vec_id, min(b) AS c FROM p GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(m.c, e.vec_id) AS BIGINT) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM embeddings e LEFT JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)"""

SQL9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT doc_id, p, array_to_string(a[p:p+12], ' ') AS k FROM w, unnest(range(1, len(a) - 11)) AS t(p)),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
hit AS (SELECT g.doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (k) WHERE m < g.doc_id),
d AS (SELECT doc_id, list(DISTINCT i) AS gone FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(list_filter(a, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN d USING (doc_id)"""

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_chat_format": op2_chat_format, "op3_bpe": op3_bpe, "op4_token_files": op4_token_files, "op5_embedding_dedup": op5_embedding_dedup, "op6_language_id": op6_language_id, "op7_decontaminate": op7_decontaminate, "op8_toxicity": op8_toxicity, "op9_substring_dedup": op9_substring_dedup, "op10_license_scan": op10_license_scan}
ORACLES = {"op2_chat_format": SQL2, "op10_license_scan": license_oracle(), "op1_ngram_jaccard": SQL1, "op5_embedding_dedup": SQL5, "op9_substring_dedup": SQL9}
