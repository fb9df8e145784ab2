"""The operators of this subpackage as queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import (
    byte_cnn, chat, hard_negatives, html_text, licenses, merkle, ngram_join, prefix_bpe, quality, tiling, token_files, toxicity,
    warc,
)
from opslens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The id that is free in that vocabulary ends documents in token files.
END_OF_DOCUMENT = 50256
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    read = chat.parse(chat.render(rows.unionByName(extra)))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns_sha256",
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "identical")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _bpe_ids():
    coder = prefix_bpe.coder_of(RANKS, public_tokenizers.PATTERN)
    return lambda text: memoryview(coder.encode_packed(text)).cast("I")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_tokens(table(spark, sf_dir, "documents"), _bpe_ids, END_OF_DOCUMENT)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), captured)[1].select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no path; source and language stand for the folders of a file."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id"))
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), path)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabelled)


#: The letters that tampering lower-cases, and what it makes of them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang",
                            {"text": F.translate("text", UPPER, LOWER)}, tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_chat_format, op3_toxicity, op4_token_counts, op5_byte_bpe, op6_string_tiling, op7_warc_index,
    op8_license_scan, op9_ngram_join, op10_html_text, op11_hard_negatives, op12_merkle_manifest, op13_byte_cnn, pipeline)}

_OP11 = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM used a JOIN used r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, n.other AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

#: The unsigned crc32 of a short ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''),
  lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i:
  CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _merkle_sql(levels: int = 7, tops: int = 4) -> str:
    """The tree level by level, for as many levels as given: 8 ** levels rows of a language, 8 ** tops languages."""
    def leaf(text):
        parts = (f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
                 for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(parts)})"

    def up(name, key, n):
        """Nodes t0.. of each level of a tree, and runs r0.. with all nodes of a run in order."""
        for k in range(n):
            yield f"""{name}c{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {name}t{k}),
{name}r{k} AS (SELECT {key}, pos // 8 AS run, max(c) AS c, list(node ORDER BY pos) AS ns FROM {name}c{k} GROUP BY ALL),
{name}t{k + 1} AS (SELECT {key}, run AS pos, CASE WHEN c > 1 THEN sha256(array_to_string(ns, '')) ELSE ns[1] END AS node
  FROM {name}r{k})"""

    def climb(name, key, n, first):
        for k in range(n):
            yield f"""p{first + k + 1} AS (SELECT p.* REPLACE (p.pos // 8 AS pos,
  CASE WHEN c > 1 THEN sha256(array_to_string(ns[:p.pos % 8], '') || cur || array_to_string(ns[p.pos % 8 + 2:], '')) ELSE cur END AS cur,
  CASE WHEN c > 1 THEN proof || array_to_string(ns[:p.pos % 8], '') || array_to_string(ns[p.pos % 8 + 2:], '') ELSE proof END AS proof)
  FROM p{first + k} p JOIN {name}r{k} r ON p.{key} IS NOT DISTINCT FROM r.{key} AND p.pos // 8 = r.run)"""

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return ",\n".join([
        f"""WITH leaves AS (SELECT doc_id, lang, {leaf("text")} AS leaf,
  CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} END AS other FROM documents)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)""",
        "at0 AS (SELECT lang, pos, leaf AS node FROM placed)", *up("a", "lang", levels),
        f"""bt0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, lang, node FROM at{levels})""",
        *up("b", "one", tops), "p0 AS (SELECT *, 0 AS one, coalesce(other, leaf) AS cur, '' AS proof FROM placed)",
        *climb("a", "lang", levels, 0),
        f"""q AS (SELECT p.* REPLACE (b.pos AS pos), b.node AS subroot FROM p{levels} p JOIN bt0 b ON p.lang IS NOT DISTINCT FROM b.lang),
p{levels + 1} AS (SELECT * FROM q)""",
        *climb("b", "one", tops, levels + 1)]) + f"""
SELECT doc_id, leaf, subroot, bt{tops}.node AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
       cur = bt{tops}.node AS verified
FROM p{levels + tops + 1}, bt{tops}
"""


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _quality_sql(alpha: float = quality.ALPHA, delta: float = quality.DELTA) -> str:
    """Counts from unnested windows; the binomial tail from the logarithms of its coefficients."""
    above = {s: f"len(list_filter({g}, lambda c: {s} > c))" for s, g in quality.GRID.items()}
    passed = ", ".join(above.values())
    reach = ", ".join(f"max({a}) FILTER (good = 0) AS top_{s}" for s, a in above.items())
    used = " OR ".join(f"coalesce(top_{s} >= place AND {a} >= place, false)" for s, a in above.items())
    places = max(map(len, quality.GRID.values()))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    CASE WHEN regexp_full_match(lang, '[a-z]{{2,3}}') THEN lang ELSE 'other' END AS stratum FROM documents),
split AS (SELECT *, {_WORDS.format("t")} AS w, string_split(t, chr(10)) AS all_lines,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
places AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM split),
windows AS (SELECT r, p, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT p + q) AS n FROM twice, (VALUES (0), (1), (2)) v(q) GROUP BY r),
counts AS (SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(all_lines) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals,
    len(regexp_extract_all(t, '[!?]')) AS n_marks FROM split LEFT JOIN covered USING (r)),
features AS (SELECT *, n_words < {quality.BASE_WORDS}
      OR 100 * n_repeat_words > {quality.BASE_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS duplicate_line_share,
    n_repeat_words / greatest(n_words, 1) AS repeat_word_share, n_capitals / greatest(word_chars, 1) AS capital_share,
    n_marks / greatest(n_words, 1) AS mark_per_word FROM counts),
labelled AS (SELECT f.*, good FROM features f JOIN (SELECT doc_id, min(quality) AS good FROM labels
    WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
binned AS (SELECT stratum, good, greatest({passed}) AS above FROM labelled),
tests AS (SELECT stratum, place, count(*) FILTER (good = 1) AS goods, count(*) FILTER (good = 0) AS bads,
    count(*) FILTER (good = 1 AND above >= place) AS k, count(*) FILTER (good = 0 AND above >= place) AS bad_lost
    FROM binned, range(1, {places + 1}) p(place) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= goods * {alpha} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
    lgamma(goods + 1) - lgamma(i + 1) - lgamma(goods - i + 1) + i * ln({alpha}) + (goods - i) * ln(1 - {alpha})))) END AS p FROM tests),
passed AS (SELECT *, max(p) OVER (PARTITION BY stratum ORDER BY place DESC) AS worst FROM tails),
best AS (SELECT stratum, arg_max(place, {{'v': bad_lost / greatest(bads, 1) - {quality.GOOD_COST} * k / greatest(goods, 1),
    'p': place}}) AS place FROM passed
    WHERE worst <= {delta} / (SELECT count(DISTINCT stratum) FROM binned) AND bad_lost > 0 GROUP BY ALL),
reached AS (SELECT stratum, {reach} FROM labelled GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({used}) AS kept, stratum
FROM features LEFT JOIN best USING (stratum) LEFT JOIN reached USING (stratum)
"""


def _coded_role(role: str) -> str:
    for plain, code in chat.ROLE_CODES:
        role = f"replace({role}, {'chr(10)' if plain == chr(10) else repr(plain) if plain != chr(92) else 'chr(92)'}, '{code}')"
    return role


#: A text with a control string is escaped, every other one stays as it is.
_OP2 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}'
    UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('### : ') + length({_coded_role("role")}) + length(regexp_replace(text, '(\\\\*)({chat.CONTROL})', '\\1\\\\\\2', 'g'))
      + {len(chat.END)})::BIGINT AS formatted_chars, true AS identical
FROM turns GROUP BY conv_id
"""

#: Five hex digits are four of base 32.
_OP7 = """
WITH bodies AS (SELECT page_id, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS url, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id, sha1(body) AS hex,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?]*)', 1)), ':[0-9]*$', ''), '^www[.]', '') AS host,
    lower(rtrim(regexp_extract(url, '^[a-z]+://[^/?]*([^?]*)', 1), '/')) AS path, regexp_extract(url, '[?](.*)$', 1) AS query
  FROM bodies),
keyed AS (SELECT *, CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
    CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(
    list_sort(string_split(query, '&')), '&') END END AS url_key,
    strftime(make_timestamp((1700000000 + coalesce(page_id, 0)) * 1000000), '%Y%m%d%H%M%S') AS ts FROM firsts)
SELECT page_id, url_key, ts, row_number() OVER (PARTITION BY url_key ORDER BY ts, page_id NULLS FIRST) AS capture, strlen(body)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM keyed
"""

_OP9 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM texts),
classes AS (SELECT min(doc_id) AS rep, count(DISTINCT doc_id) AS documents, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.rep AS x, b.rep AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM classes UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
components AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x),
links AS (SELECT x AS rep, sum(documents) AS n FROM pairs JOIN classes ON y = rep GROUP BY x)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  coalesce(c.documents - 1 + coalesce(l.n, 0), 0)::BIGINT AS n_links
FROM sets d LEFT JOIN classes c ON d.s = c.s AND c.n > 0 LEFT JOIN components USING (rep) LEFT JOIN links l USING (rep)
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality_sql(), "op2_chat_format": _OP2, "op7_warc_index": _OP7, "op9_ngram_join": _OP9,
    "op11_hard_negatives": _OP11, "op12_merkle_manifest": _merkle_sql()}
