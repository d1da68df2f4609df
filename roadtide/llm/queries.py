"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtide.llm import bpe, chat_format, lang_id, merkle_manifest, minhash_bbit, pii_boost, prefix_trie, sparse_suffix, va_topk, warc_shards
from roadtide.llm import line_dedup as line_dedup_
from roadtide.llm import poisson_mix as poisson_mix_
from roadtide.llm import quality_llr as quality_llr_
from roadtide.llm.common import saved, table, tokenizer_path


def op1_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors of every 50th."""
    vectors = va_topk.scaled(table(spark, sf_dir, "embeddings"))
    return va_topk.top_k(vectors, vectors.where("id % 50 = 0"), k=5).select("query_id", "rank", "vec_id", "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts, its length-normalised log-likelihood ratio, and the verdict."""
    return quality_llr_.quality_llr(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixed corpus, with its text, in the global order."""
    return poisson_mix_.poisson_mix(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n, 0.5)) AS raw_all, sum(n) AS docs_all FROM counts),
rates AS (SELECT source, pow(n, 0.5) * docs_all * 1.0 / (raw_all * n) AS rate FROM counts, sums),
draws AS (
  SELECT d.*, rate, ('0x' || substr(md5(concat_ws('|', 'count17', coalesce(d.source, ''), coalesce(CAST(d.doc_id AS VARCHAR), ''), '1')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (SELECT source, rate, i, exp(-rate) * pow(rate, i) / gamma(i + 1) AS p FROM rates, range(0, 81) t(i)),
cdf AS (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS c FROM terms),
drawn AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND draws.u >= c) AS k FROM draws)
SELECT doc_id, text, lang, source, n_chars, CAST(j AS INTEGER) AS mix_copy,
       md5(concat_ws('|', 'order17', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(j AS VARCHAR))) AS mix_order
FROM drawn, range(1, 100) t(j) WHERE j <= k
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines that go."""
    return line_dedup_.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
norms AS (SELECT *, trim(line, E' \\t\\n\\x0b\\x0c\\r') AS norm FROM lines),
reps AS (
  SELECT norm, length(norm) AS n, min((doc_id, line_no)) AS first FROM norms WHERE length(norm) >= 20 GROUP BY norm),
variants AS (SELECT norm, first, i, md5(substr(norm, 1, i - 1) || substr(norm, i + 1)) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM reps)),
replaced AS (SELECT a.norm FROM variants a JOIN (SELECT i, v, min(first) AS first FROM variants GROUP BY i, v) b ON a.i = b.i AND a.v = b.v AND b.first < a.first),
inserted AS (SELECT CASE WHEN v.first > r.first THEN v.norm ELSE r.norm END AS norm FROM variants v JOIN reps r ON v.v = md5(r.norm)),
near AS (SELECT norm FROM replaced UNION SELECT norm FROM inserted),
verdicts AS (
  SELECT l.doc_id, l.line_no, l.line,
         coalesce(r.first <> (l.doc_id, l.line_no) OR n.norm IS NOT NULL, false) AS gone
  FROM norms l LEFT JOIN reps r ON l.norm = r.norm LEFT JOIN near n ON l.norm = n.norm),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text
  FROM verdicts GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS INTEGER) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a classifier that has learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    return lang_id.predict(docs.select("doc_id", lang_id.held_out("doc_id").alias("held_out"), "text"), model).drop("text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and the hashes of its ids and of what they decode to."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op7_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest one that it reaches by links of three words and a similarity of 0.85."""
    return minhash_bbit.near_components(table(spark, sf_dir, "documents"), words=3, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS x FROM w),
u AS (SELECT doc_id, len(x) AS m, unnest(x) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.m AS ma, b.m AS mb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND a.m * 100 >= b.m * 85 AND b.m * 100 >= a.m * 85 GROUP BY ALL),
e AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (ma + mb - c)),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, b.b FROM reach r JOIN sides b ON r.y = b.a),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, y AS component_id, y = doc_id AS kept FROM s JOIN c ON c.x = doc_id
"""


def op8_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words or more that occur at another place too, as word positions of each document."""
    return sparse_suffix.repeated_spans(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
marked AS (SELECT DISTINCT doc_id, i FROM win WHERE h IN (SELECT h FROM twice)),
new AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS n FROM marked),
runs AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM new)
SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) + 49 AS INTEGER) AS stop FROM runs GROUP BY doc_id, g
"""


def op9_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are scanned once; the model is fitted to the candidates and applied to them."""
    scanned = saved(pii_boost.scan(table(spark, sf_dir, "documents")).drop("text"), "pii-scan")
    return pii_boost.digest(pii_boost.find(scanned, pii_boost.fit(scanned)))


def op10_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives that are written of them all."""
    manifest = warc_shards.write_warc(table(spark, sf_dir, "pages"), warc_shards.new_archive(spark))
    return warc_shards.read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def op11_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.digest(rows.select("conv_id", "turn", "role", chat_format.text_content(F.col("text")).alias("content")))


OP11_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</', '<\/'), '<|', '<\|') AS said,
         replace(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</', '<\/'), '<|', '<\|'), ': ', ':\ ') AS by_whom,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(by_whom) + 2 + length(said) + 8) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(sum(words) AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id
"""
#: Unsigned CRC-32 of x in decimal, bit by bit.
_CRC32 = """(4294967295 - list_reduce(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
  lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a & 255, b), range(8)), lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), CAST(4294967295 AS BIGINT)))"""


def op12_splitter_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with turns of the one that heads its twenty."""
    own = saved(prefix_trie.paths(table(spark, sf_dir, "conversations")), "trie-own")
    return prefix_trie.trie(prefix_trie.with_shared_heads(own))


OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d) AS l, {_CRC32.format(x="conv_id")} % 4 AS h FROM t GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:o.h], o.l[o.h + 1:]) AS l FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
deep AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM rebuilt),
pre AS (
  SELECT conv_id, depth, depth = len(l) AS ends, CASE WHEN depth > 0 THEN l[depth].w ELSE 0 END AS w, md5(array_to_string(list_transform(l[1:depth], lambda x: x.d), '')) AS k,
         CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(l[1:depth - 1], lambda x: x.d), '')) END AS up FROM deep),
node AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM pre GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS c FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(c, 0) AS c FROM node n LEFT JOIN kids USING (depth, k)),
sub AS (
  SELECT p.depth, p.k, count(*) FILTER (WHERE n.c = 0) AS leaves, sum((n.n - 1) * n.w) AS saved FROM full_ n JOIN pre p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.c AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM full_ f JOIN sub s ON s.depth = f.depth AND s.k = f.k LEFT JOIN full_ u ON u.depth = f.depth - 1 AND u.k = f.up
"""


def op13_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents, climbed by each; of every second one the line feeds were taken out since."""
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest.verify(table(spark, sf_dir, "documents"), "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": cut})


def _h(text: str) -> str:
    columns = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in columns) + ")"


def _fold(name: str, start: str) -> str:
    """Climb of the rows of start through the levels of their tree."""
    run, i = "hs[pos - pos % 3 + 1:pos - pos % 3 + 3]", "pos % 3 + 1"
    return f"""{name} AS (
  SELECT * FROM {start}
  UNION ALL
  SELECT c.id, c.tree, c.k + 1, c.pos // 3, sha256(array_to_string(list_transform({run}, lambda h, i: CASE WHEN i = {i} THEN c.folded ELSE h END), '')),
         c.proof || array_to_string(list_filter({run}, lambda h, i: i <> {i}), '')
  FROM {name} c JOIN up ON up.tree = c.tree AND up.k = c.k WHERE len(hs) > 1)"""


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_h("text")} AS leaf,
         {_h(f"(CASE WHEN doc_id IS NOT NULL AND {_CRC32.format(x='doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS now FROM documents),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low AS (
  SELECT tree, 0 AS k, list(leaf ORDER BY pos) AS hs FROM p GROUP BY tree
  UNION ALL SELECT tree, k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM low WHERE len(hs) > 1),
subroots AS (SELECT tree, hs[1] AS subroot FROM low WHERE len(hs) = 1),
high AS (
  SELECT -1 AS tree, 0 AS k, list(subroot ORDER BY tree) AS hs FROM subroots
  UNION ALL SELECT tree, k + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(hs[i + 1:i + 3], ''))) FROM high WHERE len(hs) > 1),
up AS (SELECT * FROM low UNION ALL SELECT * FROM high),
start1 AS (SELECT id, tree, 0 AS k, pos, now AS folded, '' AS proof FROM p),
{_fold("c1", "start1")},
start2 AS (SELECT id, -1 AS tree, 0 AS k, c.tree AS pos, folded, proof FROM c1 c JOIN up ON up.tree = c.tree AND up.k = c.k WHERE len(hs) = 1),
{_fold("c2", "start2")},
root AS (SELECT hs[1] AS root FROM high WHERE len(hs) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p JOIN subroots USING (tree) CROSS JOIN root JOIN (SELECT c.* FROM c2 c JOIN up ON up.tree = c.tree AND up.k = c.k WHERE len(hs) = 1) c ON c.id = p.id
"""


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_va_topk, op2_quality_llr, op3_poisson_mix, op4_lang_id, op5_bpe, op6_line_dedup, op7_minhash_bbit, op8_sparse_suffix, op9_pii_boost, op10_warc_shards,
            op11_chat_parts, op12_splitter_trie, op13_merkle_climb,
        )
    }


def oracle_sql() -> dict:
    return {"op1_va_topk": OP1_SQL, "op3_poisson_mix": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_minhash_bbit": OP7_SQL, "op8_sparse_suffix": OP8_SQL, "op10_warc_shards": OP10_SQL, "op11_chat_parts": OP11_SQL, "op12_splitter_trie": OP12_SQL, "op13_merkle_climb": OP13_SQL}
