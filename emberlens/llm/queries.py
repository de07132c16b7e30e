"""The queries of the thirteen operators, each over its whole table, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.llm import attribution, bpe, chat, jaccard, line_dedup, media, mixing, neighbours, quality, resampling, url_filter, vector_codes, word_bpe
from emberlens.session import table


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd))
    mask = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("turns"), mask.alias("mask"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("mask").cast("long").alias("loss_chars"), F.sha2("mask", 256).alias("loss_sha256"), "formatted_chars"
    )


OP1_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{chat.CONFLICT}'))
      + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
             ELSE 23 + length(role) + len(regexp_extract_all(role, '{chat.CONFLICT}')) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's record, by field: source, lang, first line and the rest of the text."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    head = F.substring_index(text, "\n", 1)
    parts = [("source", F.col("source")), ("lang", F.col("lang")), ("head", head), ("body", F.expr("substr(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\n', 1)) + 2)"))]
    return attribution.attribute_tokens(attribution.record_of(docs, parts), ranks_file(), pattern(), "largest")


def url_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the fetch time follows from page_id, as the table has none."""
    return pages.select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 365) as int), cast(pmod(page_id, 24) as int))").alias("fetched_at"))


def url_list(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the pages' own hosts by rule, as there is no list table.

    Spam domains (casino, pills, bets) are added on 2024-01-15, removed on 2024-05-01 and added again on 2024-08-01. Of the other hosts,
    those whose md5 begins with 0 or 1 are added on a day given by their md5, and those with 0 are removed 90 days later.
    """
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domains = hosts.select(F.regexp_replace("host", r"^(?:www|m|blog)\.", "").alias("key")).where(F.col("key").rlike("casino|pills|bets")).distinct()
    log = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(t).cast("timestamp").alias("listed_at")) for a, t in (("add", "2024-01-15"), ("remove", "2024-05-01"), ("add", "2024-08-01"))])
    spam = domains.select("key", F.explode(log).alias("e")).select("key", "e.action", "e.listed_at", F.lit("spam").alias("category"))
    code = F.md5("host")
    day = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(conv(substr(md5(host), 2, 2), 16, 10) as int))")
    other = hosts.where(code.rlike("^[01]"))
    added = other.select(F.col("host").alias("key"), F.lit("add").alias("action"), day.alias("listed_at"), F.lit("review").alias("category"))
    removed = other.where(code.startswith("0")).select(F.col("host").alias("key"), F.lit("remove").alias("action"), (day + F.expr("interval '90' day")).alias("listed_at"), F.lit("review").alias("category"))
    return spam.union(added).union(removed)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = url_filter.filter_captures(url_captures(pages), url_list(pages))
    return out.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "host", "blocked", "hits", "category", "matched_key")


OP3_SQL = r"""
WITH p AS (
  SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(((page_id * 37) % 365)::INT) + to_hours((page_id % 24)::INT) AS fetched_at,
    lower(rtrim(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '.')) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
spam AS (SELECT DISTINCT regexp_replace(host, '^(?:www|m|blog)\.', '') AS key FROM hosts WHERE regexp_matches(regexp_replace(host, '^(?:www|m|blog)\.', ''), 'casino|pills|bets')),
review AS (SELECT host AS key, TIMESTAMP '2024-01-01 00:00:00' + to_days(('0x' || substr(md5(host), 2, 2))::INT) AS listed, left(md5(host), 1) AS first FROM hosts WHERE left(md5(host), 1) IN ('0', '1')),
spans AS (
  SELECT key, 'spam' AS category, TIMESTAMP '2024-01-15' AS a, TIMESTAMP '2024-05-01' AS b FROM spam
  UNION ALL SELECT key, 'spam', TIMESTAMP '2024-08-01', TIMESTAMP '9999-12-31' FROM spam
  UNION ALL SELECT key, 'review', listed, CASE WHEN first = '0' THEN listed + INTERVAL 90 DAY ELSE TIMESTAMP '9999-12-31' END FROM review),
hit AS (
  SELECT p.page_id, p.url, p.fetched_at, s.key, s.category FROM p JOIN spans s
  ON (p.host = s.key OR suffix(p.host, '.' || s.key) OR p.host || p.path = s.key) AND p.fetched_at >= s.a AND p.fetched_at < s.b)
SELECT p.page_id, p.url, strftime(p.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, p.host, count(h.key) > 0 AS blocked, count(h.key)::BIGINT AS hits,
  first(h.category ORDER BY length(h.key) DESC, h.key, h.category) AS category, first(h.key ORDER BY length(h.key) DESC, h.key, h.category) AS matched_key
FROM p LEFT JOIN hit h ON p.page_id = h.page_id AND p.url IS NOT DISTINCT FROM h.url GROUP BY p.page_id, p.url, p.fetched_at, p.host
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.training_rows(docs, labels)
    net = quality.train([t for t, _ in rows], [q for _, q in rows])
    out = quality.score_documents(docs.select("doc_id", "text"), net)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of every non-empty line go, however short; lines of 30 code points or more go too when they are one edit from an earlier one."""
    return line_dedup_all_lengths(spark, sf_dir)


def line_dedup_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 30 code points or more alone."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("dedup_lines").alias("n_lines"), F.col("dedup_removed").alias("n_removed"), "text")


LONG_LINES_SQL = """
WITH l AS (
  SELECT doc_id, i AS line_no, trim(a[i], ' ') AS line, a[i] AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) u(i)),
d AS (SELECT line, min((doc_id, line_no)) AS place FROM l WHERE length(line) >= 30 GROUP BY line),
v AS (SELECT line, place, i, md5(left(line, i - 1) || substr(line, i + 1)) AS cut, length(line) AS n FROM d, unnest(range(1, length(line) + 1)) u(i)),
near AS (
  SELECT v.line FROM v JOIN (SELECT n, i, cut, min(place) AS first FROM v GROUP BY ALL HAVING count(*) > 1) g ON v.n = g.n AND v.i = g.i AND v.cut = g.cut WHERE v.place > g.first
  UNION SELECT v.line FROM v JOIN d ON v.cut = md5(d.line) WHERE d.place < v.place
  UNION SELECT d.line FROM v JOIN d ON v.cut = md5(d.line) WHERE v.place < d.place),
gone AS (
  SELECT l.doc_id, l.line_no FROM l JOIN d ON l.line = d.line WHERE (l.doc_id, l.line_no) > d.place
  UNION SELECT l.doc_id, l.line_no FROM l JOIN near ON l.line = near.line)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.line_no)::BIGINT AS n_removed, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL), '') AS text
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
"""


def line_dedup_all_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier one go, of 30 code points or more; exact repeats of every non-empty line go, however short."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return out.select("doc_id", F.col("dedup_lines").alias("n_lines"), F.col("dedup_removed").alias("n_removed"), "text")


ALL_LENGTHS_SQL = """
WITH l AS (
  SELECT doc_id, i AS line_no, trim(a[i], ' ') AS line, a[i] AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) u(i)),
e AS (SELECT line, min((doc_id, line_no)) AS place FROM l WHERE line <> '' GROUP BY line),
d AS (SELECT line, place FROM e WHERE length(line) >= 30),
v AS (SELECT line, place, i, md5(left(line, i - 1) || substr(line, i + 1)) AS cut, length(line) AS n FROM d, unnest(range(1, length(line) + 1)) u(i)),
near AS (
  SELECT v.line FROM v JOIN (SELECT n, i, cut, min(place) AS first FROM v GROUP BY ALL HAVING count(*) > 1) g ON v.n = g.n AND v.i = g.i AND v.cut = g.cut WHERE v.place > g.first
  UNION SELECT v.line FROM v JOIN d ON v.cut = md5(d.line) WHERE d.place < v.place
  UNION SELECT d.line FROM v JOIN d ON v.cut = md5(d.line) WHERE v.place < d.place),
gone AS (
  SELECT l.doc_id, l.line_no FROM l JOIN e ON l.line = e.line WHERE (l.doc_id, l.line_no) > e.place
  UNION SELECT l.doc_id, l.line_no FROM l JOIN near ON l.line = near.line)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.line_no)::BIGINT AS n_removed, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL), '') AS text
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.describe(media.store_payloads(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", F.col("digest").alias("member"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks_file(), pattern())


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.placed(mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return plan.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
        F.col("mix_copies").alias("copies"), F.col("mix_first").alias("first_at"), F.col("mix_last").alias("last_at"),
    )


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::BIGINT AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(k % 3 + 1)::INT] AS slope, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, k, source_size, slope, least(cap::DOUBLE, (SELECT arg_min(level, (ratio, k)) FROM o WHERE ratio >= level) * weight) AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.k, t.source_size, t.target, t.slope,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, (start + size <= target)::INT + (source_size + start + size <= target)::INT + (2 * source_size + start + size <= target)::INT AS whole FROM r WHERE target > 0 AND size > 0),
e0 AS (SELECT k, any_value(target) AS target, coalesce(max(CASE WHEN whole > 0 THEN (whole - 1) * source_size + start + size END), 0) AS base_end, min((whole * source_size + start, size)) FILTER (whole < 3) AS nx FROM b GROUP BY k),
f1 AS (SELECT e.k, max((b.size, -b.start)) AS x FROM e0 e JOIN b ON b.k = e.k AND b.whole < 3 AND e.base_end + b.size <= e.target GROUP BY e.k),
e1 AS (SELECT e.*, x AS x1, base_end + coalesce(x[1], 0) AS to1 FROM e0 e LEFT JOIN f1 USING (k)),
f2 AS (SELECT e.k, max((b.size, -b.start)) AS x FROM e1 e JOIN b ON b.k = e.k AND b.whole < 3 AND e.to1 + b.size <= e.target AND b.start IS DISTINCT FROM -x1[2] GROUP BY e.k),
e2 AS (SELECT e.*, x AS x2, to1 + coalesce(x[1], 0) AS to2 FROM e1 e LEFT JOIN f2 USING (k)),
f3 AS (SELECT e.k, max((b.size, -b.start)) AS x FROM e2 e JOIN b ON b.k = e.k AND b.whole < 3 AND e.to2 + b.size <= e.target AND b.start IS DISTINCT FROM -x1[2] AND b.start IS DISTINCT FROM -x2[2] GROUP BY e.k),
e3 AS (SELECT e.*, x AS x3, to2 + coalesce(x[1], 0) AS to3 FROM e2 e LEFT JOIN f3 USING (k)),
g AS (SELECT *, coalesce(base_end + nx[2] - target < target - to3, false) AS take FROM e3),
y AS (SELECT r.doc_id, r.size, r.source_size, r.target, r.slope, i * r.source_size + r.start AS place FROM r LEFT JOIN g ON g.k = r.k, (VALUES (0), (1), (2)) v(i)
  WHERE r.target > 0 AND (i * r.source_size + r.start + r.size <= r.target OR (g.take AND r.size > 0 AND i * r.source_size + r.start = g.base_end))
  UNION ALL SELECT r.doc_id, r.size, r.source_size, r.target, r.slope, CASE r.start WHEN -x1[2] THEN base_end WHEN -x2[2] THEN to1 ELSE to2 END FROM r JOIN g ON g.k = r.k AND NOT g.take AND r.size > 0 AND (r.start = -x1[2] OR r.start = -x2[2] OR r.start = -x3[2])),
p AS (SELECT *, (2 * place + size)::DOUBLE / (2 * target) AS share FROM y),
q AS (SELECT doc_id, CASE WHEN share < 1 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS time FROM p
  UNION ALL SELECT doc_id, 0.0::DOUBLE FROM r WHERE target <= 0),
m AS (SELECT doc_id, count(time)::BIGINT AS copies, min(time) AS first_at, max(time) AS last_at FROM q GROUP BY doc_id),
c AS (SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(m.copies, 0)::BIGINT AS copies, m.first_at, m.last_at FROM r LEFT JOIN m ON m.doc_id = r.doc_id)
"""
OP10_SQL = MIX_SQL + "SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies, first_at, last_at FROM c"


def mixing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's copies in the run of op10_mixing: how many, and the times of the first and the last."""
    return op10_mixing(spark, sf_dir).select("doc_id", "copies", "first_at", "last_at")


POSITIONS_SQL = MIX_SQL + "SELECT doc_id, copies, first_at, last_at FROM c"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.word_round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A word's CRC-32 is folded over its bytes with a table that eight shifts of each byte make.
OP12_SQL = r"""
WITH RECURSIVE shifts(b, c, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) u(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifts WHERE k < 8),
tbl AS (SELECT list(c ORDER BY b) AS t FROM shifts WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL),
qw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM q) GROUP BY ALL),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM v, tbl),
cs AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN b USING (w) GROUP BY bucket),
ct AS (SELECT bucket, sum(n)::BIGINT AS t FROM qw JOIN b USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM cs), 0)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM ct), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM (SELECT u.bucket::BIGINT AS bucket FROM range(10000) u(bucket)) LEFT JOIN cs USING (bucket) LEFT JOIN ct USING (bucket)),
f AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id),
x AS (
  SELECT d.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.gain // f.n - (CASE WHEN f.gain % f.n < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS weight,
    ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT AS h FROM d LEFT JOIN f ON d.doc_id = f.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, y.n_features, y.weight, y.score, r.rank FROM y LEFT JOIN r ON y.doc_id = r.doc_id AND r.rank <= 10 * r.n // 100
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other; the nearest entry is found by comparing all."""
    sql = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, u.part, x[u.part * len(x) // {parts} + 1:(u.part + 1) * len(x) // {parts}] AS v FROM kept, range({parts}) u(part)),
c0 AS (SELECT part, k, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p) WHERE k < {entries})"""
    nearest = "SELECT p.vec_id, p.part, any_value(p.v) AS v, min((list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.k)) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.vec_id, p.part"
    for r in range(rounds):
        sql += f""",
a{r} AS MATERIALIZED ({nearest.format(r=r)}),
m{r} AS (SELECT part, k, list(floor(total::DOUBLE / n)::BIGINT ORDER BY i) AS v FROM (
  SELECT part, best[2] AS k, i, sum(v[i])::BIGINT AS total, count(*) AS n FROM (SELECT part, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY part, k),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.k = m.k)"""
    return f"""{sql},
a{rounds} AS ({nearest.format(r=rounds)}),
o AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT o.vec_id, o.code, o.error, sum(o.error) OVER (PARTITION BY kept.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, k)) FROM c{rounds}) AS codebooks_sha256 FROM o JOIN kept ON o.vec_id = kept.vec_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_token_attribution, op3_url_filter, op4_quality, op5_line_dedup, op6_media, op7_neighbours, op8_bpe, op9_jaccard, op10_mixing, op11_word_bpe, op12_resampling, op13_vector_codes, pipeline, line_dedup_all_lengths, line_dedup_long_lines, mixing_positions)
}
ORACLES = {"op1_chat_format": OP1_SQL, "op3_url_filter": OP3_SQL, "op5_line_dedup": ALL_LENGTHS_SQL, "line_dedup_long_lines": LONG_LINES_SQL, "op10_mixing": OP10_SQL, "op12_resampling": OP12_SQL, "op13_vector_codes": vector_codes_sql(), "line_dedup_all_lengths": ALL_LENGTHS_SQL, "mixing_positions": POSITIONS_SQL}
