"""One registered query per operator, on its whole table and with production parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.llm import cascade, convtrie, curriculum, language, licences, multiindex, packing, pieces, pseudonyms, simhash, urlfilter, variants, wrappers

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def _(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op5_language_id")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.learn(docs.where(~F.col("held_out")))
    named = docs.select("doc_id", "held_out", language.identify("text", model).alias("p"))
    return named.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op7_packing")
def _(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


# Water filling in closed form: sources in order of cap per weight are full as long as the share of the rest exceeds it.
MIX_SQL = r"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank FROM s),
g AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS level,
    (SELECT CAST(sum(source_size) AS BIGINT) FROM g) AS total FROM g),
f AS (SELECT *, coalesce(CAST(sum(3 * source_size) OVER b AS BIGINT), 0) AS capped,
    CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER b AS BIGINT), 0) AS weights, row_number() OVER (ORDER BY level, rank) AS nth FROM c
    WINDOW b AS (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(CAST(total - capped AS DOUBLE) / weights, nth) FILTER (CAST(total - capped AS DOUBLE) / weights <= level) AS share FROM f),
t AS (SELECT source, rank, source_size, CASE WHEN weight * share > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * share END AS target FROM g, l),
d AS (SELECT w.doc_id, w.size, t.rank, t.source_size, t.target,
    CAST(sum(w.size) OVER (PARTITION BY w.source ORDER BY substr(h, 1, 8), w.doc_id, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - w.size AS begins
    FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(3, floor(target / source_size) + CASE WHEN begins + size / CAST(2 AS DOUBLE) <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) END AS passes
FROM d),
p AS (SELECT *, [TILTS][rank % N_TILTS + 1] AS tilt, least(begins / target, 1) AS done_first, least((begins + (passes - 1) * source_size) / target, 1) AS done_last FROM m)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size AS BIGINT) AS taken,
    CASE WHEN passes > 0 THEN TIME(done_first) END AS first_position, CASE WHEN passes > 0 THEN TIME(done_last) END AS last_position
FROM p"""
# The time t at which a schedule that runs evenly from tilt to 2 - tilt has asked for tilt * t - (tilt - 1) * t^2 = done.
MIX_SQL = re.sub(
    r"TIME\((\w+)\)",
    r"CASE WHEN abs(tilt - 1) < 1e-9 THEN \1 ELSE (tilt - sqrt(greatest(tilt * tilt - 4 * (tilt - 1) * \1, 0))) / (2 * CASE WHEN tilt = 1 THEN 1 ELSE tilt - 1 END) END",
    MIX_SQL.replace("N_TILTS", str(len(curriculum.TILT))).replace("TILTS", ", ".join(f"CAST({t} AS DOUBLE)" for t in curriculum.TILT)),
)


@query("op9_curriculum_mix", MIX_SQL)
def _(spark, d):
    placed = curriculum.spans(curriculum.plan(table(spark, d, "documents"), ["doc_id"]))
    return placed.select(F.col("__0").alias("doc_id"), "size", "source_size", "target", "taken", "first_position", "last_position")


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8)),
a AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM a, (SELECT unnest(range(8)) AS k) GROUP BY r),
f AS (SELECT t.r, doc_id, text, words, lines, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM t LEFT JOIN c ON c.r = t.r),
o AS (SELECT r, max(n) AS most FROM (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM t) GROUP BY r, w) GROUP BY r),
b AS (SELECT f.*, most, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f LEFT JOIN o ON o.r = f.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND coalesce(word_chars, 0) BETWEEN 2 * n_words AND 20 * n_words AND 2 * n_symbols <= n_words AND 2 * n_dup_lines <= len(lines)
    AND 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) >= 6 * n_words
    AND 10 * len(list_filter(words, lambda x: length(x) > 1 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '[\p{Ll}\p{Lt}]'))) <= 6 * n_words
    AND 10 * most <= 3 * n_words
    AND 10 * len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) <= 3 * len(lines)
    AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09\x0b\x0c\x0d]*[-*•‣·]'))) <= 9 * len(lines) AS kept
FROM b"""


@query("op6_quality_cascade", QUALITY_SQL)
def _(spark, d):
    return cascade.quality(table(spark, d, "documents")).drop("rejected_by")


@query("op3_multi_index_search")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    return multiindex.search(vectors, vectors.where("vec_id % 20 = 0"))


@query("op4_pii_pseudonyms")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, found_as="replaced").withColumn("n_replaced", F.size("replaced"))


URL_SQL = r"""
WITH p AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rh, rp, v)),
b AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
    FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
    THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN b ON b.page_id = h.page_id"""


@query("op10_url_bloom_cascade", URL_SQL)
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.listed_domains(pages)).select("page_id", "host", "path", "rule", "verdict")


@query("op2_html_wrappers")
def _(spark, d):
    return wrappers.main_texts(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_licence_scan")
def _(spark, d):
    # a document is a file of its source, a hundred ids to a directory below one for a thousand; every twentieth is named as a
    # licence file, and stands the higher the rounder its id: what such a file says governs all below it that say nothing
    n = F.col("doc_id")
    thousands, hundreds = (F.floor(n / k).cast("string") for k in (1000, 100))
    folder = F.when(n % 1000 == 0, "").when(n % 100 == 0, thousands).otherwise(F.concat_ws("/", thousands, hundreds))
    name = F.concat(F.when(n % 20 == 0, "LICENSE-").otherwise(""), n.cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", "source", F.nullif(folder, F.lit("")), name)
    scanned = licences.scan(table(spark, d, "documents").select("doc_id", path.alias("path"), "text"))
    own = F.when(F.col("licence_from") == "own", F.col("licence"))
    return scanned.select("doc_id", "path", own.alias("licence"), "cosine", F.col("licence").alias("licence_in_force"), "licence_from")


@query("op13_sentencepiece_table")
def _(spark, d):
    made = table(spark, d, "documents").select("doc_id", pieces.encode("text").alias("ids"))
    both = made.select("doc_id", "ids", pieces.decode("ids").alias("decoded"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# crc32 over the bytes of a text, by the usual table of 256 remainders.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """crc32 of a SQL text expression; the query joins ``crc``."""
    code = f"hex(encode({text}))"
    data = f"list_transform(range(0, length({code}), 2), lambda i: CAST('0x' || substr({code}, CAST(i AS INT) + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {data}), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) AS INT) + 1])), 4294967295)"


VARIANTS_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
x AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT x.word, v.word FROM x JOIN v ON v.word = x.cut UNION SELECT v.word, x.word FROM x JOIN v ON v.word = x.cut),
f AS (SELECT p.word, count(*) AS n_near, max(v.n) AS best_n, arg_min(p.near, (-v.n, p.near COLLATE "C")) AS best FROM p JOIN v ON v.word = p.near GROUP BY p.word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n
    FROM v LEFT JOIN f ON f.word = v.word),
c AS (SELECT word, word AS at FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.at AS root, g.n, CAST(g.n_near AS BIGINT) AS n_near, g.form_n
FROM g JOIN c ON c.word = g.word JOIN g AS last ON last.word = c.at AND last.form IS NULL"""


@query("op11_spelling_variants", VARIANTS_SQL)
def _(spark, d):
    return variants.variants(table(spark, d, "documents").select("doc_id", "text"))


TRIE_SQL = rf"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '') COLLATE "C", coalesce(text, '') COLLATE "C") AS nth,
    md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS turn, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(turn ORDER BY nth) AS turns, list(CAST(chars AS BIGINT) ORDER BY nth) AS chars FROM t GROUP BY conv_id),
h AS (SELECT l.*, CAST({crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS INT) AS h FROM l, crc),
b AS (SELECT h.conv_id, list_concat(coalesce(f.turns, [])[1:h], h.turns[h + 1:]) AS turns, list_concat(coalesce(f.chars, [])[1:h], h.chars[h + 1:]) AS chars
    FROM h LEFT JOIN l AS f ON f.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, CASE WHEN d > 0 THEN md5(array_to_string(turns[1:d], ' ')) ELSE '' END AS k, CASE WHEN d > 1 THEN md5(array_to_string(turns[1:d - 1], ' ')) WHEN d = 1 THEN '' END AS up,
    CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS c, d = len(turns) AS ends
    FROM (SELECT conv_id, turns, chars, CAST(unnest(range(len(turns) + 1)) AS INT) AS d FROM b)),
n AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
x AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.k = n.up
    LEFT JOIN (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up) AS m ON m.d = n.d AND m.k = n.k),
-- a node's ancestors are the prefixes of any conversation through it
s AS (SELECT a.d, a.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.c) AS saved_tokens
    FROM x JOIN p AS a ON a.conv_id = x.conv_id AND a.d <= x.d GROUP BY a.d, a.k)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, x.parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.d = x.d AND s.k = x.k"""


@query("op12_conversation_trie", TRIE_SQL)
def _(spark, d):
    return convtrie.prefix_trie(table(spark, d, "conversations"))
