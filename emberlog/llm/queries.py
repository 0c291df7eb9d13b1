"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import chat, decontam, embeddings, html, langid, linededup, mixing, pieces, simhash, spelling, toxicity, trie, warc
from emberlog.llm.common import stored, table
from emberlog.session import broadcast_if_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS draw FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3 AS cap FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(cap::DOUBLE, weight * max(lev) OVER ()) AS target FROM levels),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
drawn AS (
  SELECT r.*, w.source_size, w.target, w.whole,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE
      <= w.target - w.whole * w.source_size AS fits
  FROM rows r JOIN wanted w ON r.source IS NOT DISTINCT FROM w.source),
limited AS (SELECT *, max(CASE WHEN fits THEN draw END) OVER (PARTITION BY source) AS last_draw FROM drawn)
SELECT doc_id, size, source_size, target,
  (least(whole + CASE WHEN target > 0 AND coalesce(draw <= last_draw, false) THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM limited""")
def op1_mixing(spark, sf_dir):
    """All documents mixed: weights 1, 2, 3 over the sources, 100 % of all words, at most 3 epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH polynomial AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
texts AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM texts WHERE len(ws) >= 45),
hashes AS (
  SELECT w, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(hx), 2), lambda i: ('0x' || hx[i:i + 1])::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT w, hex(encode(w)) AS hx FROM placed), polynomial),
least AS (
  SELECT doc_id, n, pos, min(h * 2147483648 + pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS v
  FROM placed JOIN hashes USING (w)),
starts AS (
  SELECT doc_id, (v % 2147483648)::BIGINT AS pos FROM least WHERE pos <= n - 6 AND v % 2147483648 <= n - 45
  UNION SELECT doc_id, 0 FROM placed UNION SELECT doc_id, n - 45 FROM placed),
stretches AS (SELECT doc_id, pos, ws[pos + 1:pos + 45] AS content FROM starts JOIN texts USING (doc_id)),
firsts AS (
  SELECT *, first_value(doc_id) OVER before AS first_doc, first_value(pos) OVER before AS first_pos FROM stretches
  WINDOW before AS (PARTITION BY content ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 45)) AS pos FROM firsts WHERE doc_id <> first_doc OR pos >= first_pos + 45),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS p FROM texts)),
kept AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.pos) FILTER (g.pos IS NULL) AS rest, count(g.pos) AS words_deleted
  FROM pieces p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN words_deleted > 0 THEN regexp_extract(d.text, '^[\x20\x09-\x0D]*') || coalesce(k.rest, '') ELSE d.text END AS text,
  coalesce(words_deleted, 0)::BIGINT AS words_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)""")
def op10_line_dedup(spark, sf_dir):
    """All documents without later copies of passages of 50 words or more, wherever they start and end."""
    deduped = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    deleted = F.aggregate("deleted_runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return deduped.select("doc_id", "text", deleted.alias("words_deleted"))


@query()
def op3_simhash(spark, sf_dir):
    """SimHash of all documents: 3-word shingles, fingerprints linked at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", F.col("component").alias("component_id"))


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


@query()
def op9_language_id(spark, sf_dir):
    """The language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 3) != 1)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op8_decontamination(spark, sf_dir):
    """Every leak of a benchmark item in a document: where it is and with how many edits."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_toxicity(spark, sf_dir):
    """How likely every document is toxic, learned from the labels of the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 5) != 0)
    # 16 bytes a label: within a measured bound they are sent to the texts, beyond it both sides are shuffled
    model = toxicity.train(docs.join(broadcast_if_small(labels, max_rows=2_000_000), "doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_embeddings(spark, sf_dir):
    """All embeddings: links at cosine 0.98 or more within a label, components and what is kept."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op2_chat(spark, sf_dir):
    """All conversations, and one that says control strings, formatted; digests read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chat(rows.unionByName(extra)))


@query()
def op4_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query(r"""
WITH cut AS (
  SELECT page_id, coalesce(html, '') AS body, regexp_replace(trim(url), '#.*$', '') AS u FROM pages WHERE page_id IS NOT NULL),
parts AS (
  SELECT page_id, body, page_id * 60000 + 1704067200000 AS ms,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query
  FROM cut),
p AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS link,
    '"' || substr(md5(body), 1, 16) || '"' AS tag, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS modified,
    octet_length(encode(body)) AS size FROM parts),
v AS (SELECT *, ms + 604800000 AS again FROM p),
f AS (
  SELECT v.page_id, v.link AS url, v.again, v.tag, v.modified, r.page_id AS other, r.ms AS other_at, r.tag AS other_tag, r.modified AS other_modified,
    r.size AS other_size
  FROM v ASOF LEFT JOIN p r ON v.link = r.link AND v.again > r.ms),
o AS (
  SELECT *, CASE WHEN other IS NULL THEN 'no_response' WHEN page_id % 4 = 3 THEN 'no_validator'
    WHEN page_id % 4 < 2 AND tag = other_tag OR page_id % 4 = 2 AND modified = other_modified THEN 'resolved' ELSE 'mismatch' END AS outcome FROM f)
SELECT page_id, url, again AS revisit_ms, outcome, other AS response_page_id, other_at AS response_ms,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' ||
    CASE WHEN page_id % 4 = 2 THEN chr(10) || 'etag: ' || other_tag ELSE chr(10) || 'last-modified: ' || other_modified END ||
    chr(10) || 'content-length: ' || other_size ||
    CASE page_id % 4 WHEN 0 THEN chr(10) || 'etag: ' || tag WHEN 1 THEN chr(10) || 'etag: W/' || tag ELSE chr(10) || 'last-modified: ' || modified END ||
    chr(10) || 'cache-control: max-age=3600' END AS headers
FROM o""")
def op7_warc(spark, sf_dir):
    """Captures of all pages rendered as WARC records, read back, and their not-modified revisits resolved."""
    records = warc.parse_records(warc.render_captures(table(spark, sf_dir, "pages")))
    found = warc.resolve_revisits(records)
    page = lambda c: F.regexp_extract(c, r"(\d+)>$", 1).cast("long")
    shown = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select(page("record_id").alias("page_id"), "url", F.col("at").alias("revisit_ms"), "outcome",
                        page("response_id").alias("response_page_id"), F.col("response_at").alias("response_ms"), shown.alias("headers"))


@query()
def op13_sentencepiece(spark, sf_dir):
    """Every whole document encoded with a public vocabulary and decoded again: digests of ids and text."""
    import public_tokenizers

    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(r"""
WITH polynomial AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(hx), 2), lambda i: ('0x' || hx[i:i + 1])::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM counted, polynomial),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
vocab AS (SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, j, substr(word, 1, j - 1) || substr(word, j + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM vocab)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.j = b.j AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN vocab v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN vocab v ON c.rest = v.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM pairs GROUP BY word),
formed AS (
  SELECT v.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN near USING (word)),
followed AS (
  WITH RECURSIVE f AS (
    SELECT word, form AS root FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT f.word, g.form FROM f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL)
  SELECT f.word, f.root FROM f JOIN formed g ON f.root = g.word WHERE g.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n FROM formed LEFT JOIN followed USING (word)""")
def op11_spelling(spark, sf_dir):
    """The words of all documents (a letter missing here and there), the words near each, and the common form each belongs to."""
    found = spelling.runs(table(spark, sf_dir, "documents"), least=7)
    place = F.crc32(F.encode(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")), "UTF-8"))
    slip = spelling.without_letter(F.col("word"), (F.col("_h") % F.char_length("word")).cast("int"))
    words = found.withColumn("_h", place).select(F.when(F.col("_h") % 31 == 0, slip).otherwise(F.col("word")).alias("word"))
    return spelling.group_variants(spelling.vocabulary(words))


@query(r"""
WITH crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM said), crc),
rebuilt AS (
  SELECT c.conv_id, p, t FROM convs c JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 100 AND p < h
  UNION ALL SELECT c.conv_id, p, t FROM convs c JOIN said s ON s.conv_id = c.conv_id AND p >= h),
deep AS (
  SELECT conv_id, row_number() OVER w AS depth, list(t) OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT conv_id, 0 AS depth, deep.path[1:0] AS path FROM convs LEFT JOIN (SELECT path FROM deep LIMIT 1) deep ON true UNION ALL SELECT * FROM deep),
sizes AS (SELECT conv_id, max(depth) AS m FROM placed GROUP BY conv_id),
nodes AS (
  SELECT depth, coalesce(path, []) AS path, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (m = depth), '') AS ends
  FROM placed JOIN sizes USING (conv_id) GROUP BY ALL),
kids AS (SELECT a.depth, a.path, count(b.path) AS n_children FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY a.depth, a.path),
full_nodes AS (SELECT * FROM nodes JOIN kids USING (depth, path)),
below AS (
  SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(CASE WHEN b.depth > 0 THEN (b.n - 1) * length(b.path[b.depth].text) ELSE 0 END) AS saved
  FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.depth, a.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN below USING (depth, path) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]""")
def op12_prefix_trie(spark, sf_dir):
    """All conversations, each rebuilt on the first turns of one it shares with others, as a trie of their prefixes."""
    own = stored(trie.conversations(table(spark, sf_dir, "conversations")), "conversations")
    shared = own.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_turns"))
    turns = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("_h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)
    none = F.slice("turns", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("_turns", none), F.lit(1), F.col("_h").cast("int")), F.slice("turns", F.col("_h").cast("int") + 1, F.size("turns")))
    return trie.prefix_trie(turns.join(shared, "_base", "left").select("conv_id", rebuilt.alias("turns")))
