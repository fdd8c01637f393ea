"""Queries of the text, token and URL functions over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.sources import tables as S
from vidweave.sources.tables import table, with_ctes

#: Words that occur in the given texts, in place of technical terms.
RULES = [("(?iu)\\bthe\\s+and\\b", "THE-AND"), ("(?iu)\\bthat\\s+is\\b", "That-Is")]
GLOSSARY = [("(?:erth)", "Erth$1"), ("\\Qa.b\\E", "AB")]
FAILURES = [("HTTP_412", ["412", "precondition"]), ("FORBIDDEN", ["403", "was"]), ("LOGIN", ["login", "with"]), ("NETWORK", ["timeout", "that"])]
GUARDS = [("override", ["thand", "ouhe"]), ("bypass", ["erst", "ingth"]), ("leak", ["thand", "of the"])]
GROUPS = [(["asr", "that"], ["asr", "speech"]), (["summary", "with"], ["summary", "outline"])]


def b1_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    dirty = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("﻿ \x07"), "text", F.lit("  \t"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(T.normalize_text(dirty)).alias("text_md5"))


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{FEFF}}\x{{FFFD}}]', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""
_RISK = r"""(length({0}) >= 12 AND len(regexp_extract_all({0}, '[ÃÂåæçèéð]')) > 2 * len(regexp_extract_all({0}, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]')) AND len(regexp_extract_all({0}, '[ÃÂåæçèéð]')) > 6)"""
B1 = f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN chr(65279) || ' ' || chr(7) || text || '  ' || chr(9) ELSE text END AS t FROM documents),
y AS (SELECT doc_id, {_NORM.format('t')} AS t FROM x) SELECT doc_id, md5(translate(CASE WHEN {_RISK.format('t')} THEN '' ELSE t END, '妳祢', '你你')) AS text_md5 FROM y"""


def b2_text_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.text_quality(F.col("text")).alias("q")).select("doc_id", "q.replacement", "q.control", "q.latin", "q.cjk", "q.garbled_risk")


B2 = f"""SELECT doc_id, CAST(0 AS BIGINT) + len(regexp_extract_all(text, '\\x{{FFFD}}')) AS replacement, CAST(len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]')) AS BIGINT) AS control,
len(regexp_extract_all(text, '[ÃÂåæçèéð]')) AS latin, len(regexp_extract_all(text, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]')) AS cjk, {_RISK.format('text')} AS garbled_risk FROM documents"""


def b3_repair_encoding(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", T.repair_encoding(F.col("text"), only_if_cjk_gain=True).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("text_md5"), "r.changed")


# the tables hold no CJK, so a re-decoded text never has more of it
B3 = f"""WITH y AS (SELECT doc_id, coalesce(text, '') AS o, {_NORM.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, md5(x) AS text_md5, x <> o AS changed FROM (SELECT doc_id, o, CASE WHEN {_RISK.format('t')} THEN '' ELSE t END AS x FROM y)"""


def b4_correct_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.correct_terms(F.col("text"), RULES)).alias("text_md5"))


B4 = r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe[ \t\n\x0B\f\r]+and\b', 'THE-AND', 'g'), '(?i)\bthat[ \t\n\x0B\f\r]+is\b', 'That-Is', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM documents"""


def b5_repair_transcript(spark: SparkSession, d: str) -> DataFrame:
    r = S.segments(spark, d).select("id", T.repair_transcript(F.col("content")).alias("r"))
    return r.select("id", F.md5("r.text").alias("text_md5"), "r.changed")


def b6_token_count(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(spark, d).select("id", T.token_count(F.col("content")).alias("token_count"))


B6 = with_ctes("segments") + "SELECT id, CAST(greatest(1, length(content) // 2) AS BIGINT) AS token_count FROM segments"


def b7_apply_glossary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.apply_glossary(F.col("text"), GLOSSARY)).alias("text_md5"))


B7 = f"""WITH y AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents), z AS (SELECT doc_id, CASE WHEN {_RISK.format('t')} THEN '' ELSE t END AS t FROM y)
SELECT doc_id, md5(replace(regexp_replace(t, '(?i)erth', 'Erth$1', 'g'), 'a.b', 'AB')) AS text_md5 FROM z"""


def b12_compact_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return S.segments(spark, d).select("id", T.compact_text(c, 40).alias("answer"), T.compact_text(c, 40, "...").alias("kb"), T.compact_text(c, 40, "...", 40).alias("export"))


_COLL = r"trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
B12 = with_ctes("segments") + f""", c AS (SELECT id, {_COLL} AS x FROM segments) SELECT id, CASE WHEN length(x) > 40 THEN substr(x, 1, 39) || '…' ELSE x END AS answer,
CASE WHEN length(x) > 40 THEN substr(x, 1, 39) || '...' ELSE x END AS kb, CASE WHEN length(x) > 40 THEN substr(x, 1, 40) || '...' ELSE x END AS export FROM c"""


def b13_format_time(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(spark, d).withColumn("label", F.concat(T.format_time(F.col("start_ms") * 7), F.lit("-"), T.format_time(F.col("end_ms") * 7)))
    return s.select("id", "label", T.parse_time_range(F.col("label")).alias("r")).select("id", "label", "r.start_ms", "r.end_ms")


_FT = "printf('%02d:%02d', CAST(({0}) // 60000 AS BIGINT), CAST(({0}) // 1000 % 60 AS BIGINT))"
B13 = with_ctes("segments") + f"SELECT id, {_FT.format('start_ms * 7')} || '-' || {_FT.format('end_ms * 7')} AS label, start_ms * 7 // 1000 * 1000 AS start_ms, end_ms * 7 // 1000 * 1000 AS end_ms FROM segments"


def b14_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", T.canonical_url(F.concat(F.lit("see "), "url", F.lit(" now."))).alias("url"))
    return p.select("page_id", "url", T.platform(F.col("url"), {"example.com": "com", "example.org": "org"}).alias("platform"))


B14 = r"""WITH u AS (SELECT page_id, regexp_replace(regexp_extract('see ' || url || ' now.', 'https?://[^ ]+'), '[\])}>,.;!?，。；！？、）】》]+$', '') AS url FROM pages),
h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM u)
SELECT page_id, url, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'com' WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'org' ELSE 'unsupported' END AS platform FROM h"""


def b15_classify_failure(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.classify_failure(F.col("text"), FAILURES).alias("failure"))


def _cases(x: str, rules: list, other: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in rules) + f" ELSE {other} END"


B15 = f"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(right(text, 500), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS x FROM documents) SELECT doc_id, {_cases('x', FAILURES, "'other'")} AS failure FROM t"""


def b16_sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.sanitize_filename(F.col("url")).alias("name"))


B16 = r"""WITH x AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS n FROM pages) SELECT page_id, CASE WHEN trim(n) = '' THEN 'video.bin' ELSE n END AS name FROM x"""


def b17_mask_secret(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))


B17 = "SELECT c_custkey, '****' || right(c_name, 4) AS masked FROM customer"


def b18_guardrail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.guardrail(F.col("text"), GUARDS).alias("reason"), T.guardrail(F.col("text")).alias("default_reason"))


B18 = f"SELECT doc_id, {_cases('lower(trim(text))', GUARDS, 'NULL')} AS reason, {_cases('lower(trim(text))', [(n, [x.replace(chr(39), chr(39) * 2) for x in ws]) for n, ws in T.GUARDRAILS], 'NULL')} AS default_reason FROM documents"


def b19_question_intent(spark: SparkSession, d: str) -> DataFrame:
    m = S.messages(spark, d)
    c = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Hello"), F.lit("!"))).when(F.col("id") % 5 == 1, F.lit("为什么呢？")).otherwise(F.col("content"))
    return m.select("id", T.question_intent(c).alias("intent"))


def _any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def _in(x: str, words: list[str]) -> str:
    return f"{x} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


B19 = with_ctes("messages") + rf""", q AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Hello!' WHEN 1 THEN '为什么呢？' ELSE content END AS c FROM messages),
b AS (SELECT id, lower(c) AS low, regexp_replace(lower(c), '[\s\x0B!-/:-@\[-`{{-~，。！？、：；“”‘’（）【】《》]+', '', 'g') AS x FROM q)
SELECT id, CASE WHEN length(x) <= 10 AND {_in('x', T.GREETINGS)} THEN 'GREETING' WHEN {_any('x', T.INTRO)} THEN 'INTRO'
WHEN {_any('x', T.FOLLOW_ANY)} OR {" OR ".join(f"starts_with(x, '{s}')" for s in T.FOLLOW_START)} OR (length(x) <= 12 AND NOT contains(x, '视频') AND {_any('x', T.FOLLOW_SHORT)}) OR {_in('x', T.FOLLOW_EXACT)} THEN 'FOLLOW_UP'
WHEN {_any('low', T.COMPARISON)} THEN 'COMPARISON' ELSE 'NORMAL' END AS intent FROM b"""

WORDS = ["thand", "ouhe", "erst"]


def b20_transcript_search(spark: SparkSession, d: str) -> DataFrame:
    q = F.broadcast(spark.createDataFrame([(w,) for w in WORDS], "query string"))  # three fixed search words
    hits = S.segments(spark, d).join(q, F.lower("content").contains(F.lower("query")))
    rank = F.row_number().over(Window.partitionBy("query", "video_id").orderBy("start_ms"))
    return hits.withColumn("r", rank).where("r <= 5").select("query", "video_id", "segment_index", F.col("r").cast("long").alias("rank"))


B20 = with_ctes("segments") + f"""SELECT query, video_id, segment_index, rank FROM (SELECT query, video_id, segment_index, row_number() OVER (PARTITION BY query, video_id ORDER BY start_ms) AS rank
FROM segments JOIN (SELECT unnest({WORDS!r}) AS query) q ON contains(lower(content), query)) WHERE rank <= 5"""


def b21_timeline_seek(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(spark, d).where("start_ms >= 3000")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms")).cast("long")).where("rank <= 8").select("video_id", "segment_index", "rank")


B21 = with_ctes("segments") + "SELECT * FROM (SELECT video_id, segment_index, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS rank FROM segments WHERE start_ms >= 3000) WHERE rank <= 8"


def b22_usable_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'signup'")
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return e.where((F.col("ts") + F.expr("INTERVAL 24 HOURS") > as_of) & (F.col("ts") <= as_of)).select("event_id", "user_id")


B22 = "SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-15'"


def c1_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_TOK = "list_filter(regexp_extract_all(lower({0}), '([a-z0-9]+)', 1), lambda x: length(x) >= 2)"
C1 = f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)"


def c2_expand_domain(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(spark, d).select("question_id", F.array_join(T.expand(F.col("question"), T.tokenize(F.col("question")), GROUPS), " ").alias("tokens"))


_GR = " || ".join("CASE WHEN " + " OR ".join(f"contains(lower(question), '{n}')" for n in on) + f" THEN {add!r} ELSE [] END" for on, add in GROUPS)
C2 = with_ctes("questions") + f"SELECT question_id, array_to_string({_TOK.format('question')} || {_GR}, ' ') AS tokens FROM questions"


def c3_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    t = S.questions(spark, d).select("question_id", F.explode(T.tokenize(F.col("question"))).alias("t"))
    return t.select("question_id", T.hash_bucket(F.col("t")).cast("long").alias("bucket")).groupBy("question_id", "bucket").agg(F.count(F.lit(1)).alias("value"))


_HASH = "(list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: (a * 31 + b) & 4294967295, CAST(0 AS BIGINT)) & 2147483647) % 256"
C3 = with_ctes("questions") + f"SELECT question_id, {_HASH.format('t')} AS bucket, count(*) AS value FROM (SELECT question_id, unnest({_TOK.format('question')}) AS t FROM questions) GROUP BY ALL"


def c6_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(spark, d).select("question_id", F.array_join(T.query_terms(F.col("question"), synonyms=GROUPS), " ").alias("terms"), F.array_join(T.kb_query_terms(F.col("question"), GROUPS), " ").alias("kb_terms"))


_RAW = "list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: length(x) >= 2{0})"
C6 = with_ctes("questions") + f"""SELECT question_id, array_to_string({_RAW.format(' AND NOT ' + _in('x', T.QUERY_STOP_WORDS))} || {_GR}, ' ') AS terms,
array_to_string((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(k) AS x, generate_subscripts(k, 1) AS i FROM (SELECT {_RAW.format('')} || {_GR} AS k)) GROUP BY x)), ' ') AS kb_terms FROM questions"""

TERMS = ["that", "with", "is", "therhean", "thand", "thand"]


def c8_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*map(F.lit, TERMS))
    return S.segments(spark, d).select("id", T.keyword_score(F.col("content"), terms).alias("score"), T.kb_score(F.col("content"), terms).alias("kb_score"))


C8 = with_ctes("segments") + "SELECT id, CAST(" + " + ".join(f"CASE WHEN contains(lower(content), '{t}') THEN {2 if len(t) >= 5 else 1} ELSE 0 END" for t in TERMS) + " AS BIGINT) AS score, CAST(" + " + ".join(f"CASE WHEN contains(lower(content), '{t}') THEN {max(2, len(t))} ELSE 0 END" for t in TERMS) + " AS BIGINT) AS kb_score FROM segments"

QUERIES = {f.__name__: f for f in (b1_normalize_text, b2_text_quality, b3_repair_encoding, b4_correct_terms, b5_repair_transcript, b6_token_count, b7_apply_glossary, b12_compact_text, b13_format_time, b14_canonical_url, b15_classify_failure, b16_sanitize_filename, b17_mask_secret, b18_guardrail, b19_question_intent, b20_transcript_search, b21_timeline_seek, b22_usable_tokens, c1_tokenize, c2_expand_domain, c3_hash_embed, c6_query_terms, c8_keyword_score)}
ORACLES = {"b1_normalize_text": B1, "b2_text_quality": B2, "b3_repair_encoding": B3, "b4_correct_terms": B4, "b6_token_count": B6, "b7_apply_glossary": B7, "b12_compact_text": B12, "b13_format_time": B13, "b14_canonical_url": B14, "b15_classify_failure": B15, "b16_sanitize_filename": B16, "b17_mask_secret": B17, "b18_guardrail": B18, "b19_question_intent": B19, "b20_transcript_search": B20, "b21_timeline_seek": B21, "b22_usable_tokens": B22, "c1_tokenize": C1, "c2_expand_domain": C2, "c3_hash_embed": C3, "c6_query_terms": C6, "c8_keyword_score": C8}
