"""Queries of the document operators over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.operators import documents as D
from vidweave.operators import relational as R
from vidweave.sources import tables as S
from vidweave.sources.tables import table, with_ctes

from .text_queries import _NORM, _RISK

#: Words that occur in the given texts, some only over the border of two segments.
RULES = [D.ContextRule(("thand", "erst"), "the and", "THE-AND"), D.ContextRule((), "of the", "OF-THE", weak=("ouhe", "ingth", "was the", "zzz")), D.ContextRule(("that the", "nowhere"), "with the", "WITH")]


def a1_load_tables(spark: SparkSession, d: str) -> DataFrame:
    """The video table, with a column that old data lacks filled in."""
    old = S.videos(spark, d).select("video_id", "user_id")
    legacy = old.unionByName(old.limit(0).withColumn("version", F.lit(None).cast("long")), allowMissingColumns=True)
    return legacy.withColumn("version", F.coalesce("version", F.lit(0).cast("long")))


A1 = with_ctes("videos") + "SELECT video_id, user_id, CAST(0 AS BIGINT) AS version FROM videos"


def a2_parse_asr_json(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    item = F.struct("i", F.col("t").alias("text"), F.struct((F.col("i").cast("long") * 1000).alias("from"), F.when(F.col("i") % 2 == 0, F.col("i").cast("long") * 1000 + 900).alias("to")).alias("offsets"))
    j = s.groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("transcription"))).alias("json"))
    return D.parse_asr_json(j).select("video_id", "language", "segment_index", "start_ms", "end_ms")


# blank lines and those that normalising empties go, then the rest are numbered
A2 = f"""WITH s AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
y AS (SELECT video_id, i, {_NORM.format('t')} AS t FROM s), z AS (SELECT video_id, i, CASE WHEN {_RISK.format('t')} THEN '' ELSE t END AS t FROM y)
SELECT video_id, 'unknown' AS language, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS segment_index, CAST(i * 1000 AS BIGINT) AS start_ms, CAST(CASE WHEN i % 2 = 0 THEN i * 1000 + 900 ELSE i * 1000 + 1 END AS BIGINT) AS end_ms FROM z WHERE t <> ''"""


def a4_parse_ocr_json(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation as the screen samples of a video."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    sample = F.struct(k.cast("int").alias("segmentIndex"), (k * 1000).cast("long").alias("startMs"), (k * 1000 + 900).cast("long").alias("endMs"), F.col("c_name").alias("asrText"), F.concat(F.lit(" "), "c_name").alias("ocrText"), F.when(k % 3 != 0, (k % 100) / 100).alias("confidence"), F.when(k % 2 == 0, True).alias("available"))
    j = c.groupBy(F.col("c_nationkey").cast("long").alias("video_id")).agg(F.to_json(F.struct(F.lit(True).alias("available"), F.collect_list(sample).alias("samples"))).alias("json"))
    return D.parse_ocr_json(j)


A4 = """SELECT CAST(c_nationkey AS BIGINT) AS video_id, CAST(c_custkey AS BIGINT) AS segment_index, CAST(c_custkey * 1000 AS BIGINT) AS start_ms, CAST(c_custkey * 1000 + 900 AS BIGINT) AS end_ms, c_name AS asr, c_name AS ocr,
CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 / 100 ELSE 0.0 END AS confidence, c_custkey % 2 = 0 AS available FROM customer"""


def a5_vad_map(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(spark, d)
    m = s.select("video_id", (F.col("start_ms") * 2).alias("start_ms"), (F.col("end_ms") * 2 - 500).alias("end_ms"), F.col("start_ms").alias("mapped_start_ms"), F.col("end_ms").alias("mapped_end_ms"))
    return D.read_vad_map(D.write_vad_map(m))


A5 = with_ctes("segments") + "SELECT video_id, start_ms * 2 AS start_ms, end_ms * 2 - 500 AS end_ms, start_ms AS mapped_start_ms, end_ms AS mapped_end_ms FROM segments"


def _fenced(json) -> Column:
    return F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```\n"))).otherwise(json)


def a8_parse_generated_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Generated lists with and without a fence, some of them blank, some texts no JSON."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    lists = [F.array(F.concat(F.lit(" "), "c_name"), F.lit(" "), F.lit(name)).alias(name) for name in list(D.BUNDLE_LISTS)[:4]]
    last = F.when(k % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("x"))).alias("engineeringInsights")
    text = F.when(k % 7 == 0, F.lit("no json")).otherwise(F.to_json(F.struct(*lists, last)))
    good, bad = D.parse_generated_bundle(c.select("c_custkey", _fenced(text).alias("content")))
    lists = good.select("c_custkey", F.lit(True).alias("accepted"), F.array_join(F.concat("core_points", "ppt_outline", "engineering_insights"), "|").alias("lists"))
    return lists.unionByName(bad.select("c_custkey", F.lit(False).alias("accepted"), F.lit("").alias("lists")))


A8 = "SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS accepted, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_name || '|corePoints|' || c_name || '|pptOutline|x' ELSE '' END AS lists FROM customer"


def a9_parse_export_document(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    section = lambda h, b: F.struct(h.alias("heading"), b.alias("bullets"))
    sections = F.array(section(F.lit(" "), F.array(F.lit("lost"))), section(F.lit("empty"), F.array(F.lit(" "))), section(F.col("c_name"), F.array(F.lit(" one "), F.lit("two"))))
    json = F.to_json(F.struct(F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.lit("short").alias("executiveSummary"), sections.alias("sections"), F.array(F.lit(""), F.lit("act")).alias("actionItems")))
    good, bad = D.parse_export_document(c.select("c_custkey", _fenced(json).alias("content")))
    got = good.select("c_custkey", F.lit(True).alias("accepted"), F.md5(D.render_markdown(F.col("title"), F.col("subtitle"), F.col("summary"), F.col("sections"), F.col("actions"), ("S", "N"))).alias("markdown_md5"))
    return got.unionByName(bad.select("c_custkey", F.lit(False).alias("accepted"), F.lit("").alias("markdown_md5")))


A9 = r"""SELECT c_custkey, c_custkey % 4 <> 0 AS accepted, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE md5('# ' || c_name || chr(10) || chr(10) || '## S' || chr(10) || chr(10) || 'short' || chr(10) || chr(10) || '## ' || c_name || chr(10) || chr(10)
|| '- one' || chr(10) || '- two' || chr(10) || chr(10) || '## N' || chr(10) || chr(10) || '- act' || chr(10) || chr(10)) END AS markdown_md5 FROM customer"""


def b11_ocr_evidence_terms(spark: SparkSession, d: str) -> DataFrame:
    """Videos of which the screen shows one name each, over segments with misheard names at their end."""
    s = S.segments(spark, d).withColumn("content", F.concat("content", F.lit(" A站 AZN skyo Skil code  code")))
    k = F.col("video_id") % 4
    seen = S.videos(spark, d).select("video_id", F.when(k == 0, "The AGENT menu").when(k == 1, "skil list").when(k == 2, "Claude Code").alias("ocr"))
    return D.ocr_evidence_terms(s, seen).select("id", F.md5("content").alias("content_md5"))


B11 = with_ctes("segments") + r"""SELECT id, md5(CASE video_id % 4 WHEN 0 THEN replace(replace(replace(c, 'A阵', 'agent'), 'AZN', 'agent'), 'A站', 'agent')
WHEN 1 THEN regexp_replace(regexp_replace(regexp_replace(c, '(?i)\bskyo\b', 'skill', 'g'), '(?i)\bskil\b', 'skill', 'g'), '(?i)Skills\b', 'skills', 'g')
WHEN 2 THEN regexp_replace(regexp_replace(c, '(?i)Code\s*code', 'Claude Code', 'g'), '(?i)Claude\s*Code', 'Claude Code', 'g') ELSE c END) AS content_md5
FROM (SELECT id, video_id, content || ' A站 AZN skyo Skil code  code' AS c FROM segments)"""


def a6_summary_items(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names as summaries: in points, hooks, items, in other JSON, in broken JSON, or in no JSON at all."""
    c = table(spark, d, "customer")
    k, q = F.col("c_custkey") % 8, F.concat(F.lit('"'), "c_name", F.lit('"'))
    forms = ['{"points": [" ', '", ""], "items": ["x"]}', '{"points": [], "hooks": ["', '"]}', '["', '"]', '{"points": ["a", ', ", }", '{"items": [7, true, null, {"x": 1}, "', '"]}']
    json = F.when(k == 0, F.concat(F.lit(forms[0]), "c_name", F.lit(forms[1]))).when(k == 1, F.concat(F.lit(forms[2]), "c_name", F.lit(forms[3]))).when(k == 2, F.concat(F.lit(forms[4]), "c_name", F.lit(forms[5])))
    json = json.when(k == 3, F.concat(F.lit("{"), "c_name", F.lit("}"))).when(k == 4, F.concat(F.lit(forms[6]), q, F.lit(forms[7]))).when(k == 5, F.concat(F.lit(forms[8]), "c_name", F.lit(forms[9]))).when(k == 6, " ").otherwise(F.col("c_name"))
    return c.select("c_custkey", F.array_join(D.summary_items(json), "|").alias("items"))


A6 = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN '' WHEN 3 THEN '{' || c_name || '}' WHEN 4 THEN '{"points": ["a", "' || c_name || '", }' WHEN 5 THEN '7|true|' || c_name WHEN 6 THEN '' ELSE c_name END AS items FROM customer"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    none = S.videos(spark, d).limit(0).select("video_id", F.lit(0).cast("long").alias("version_no"))
    return R.snapshot_versions(S.segments(spark, d), none)


def a7_parse_snapshot_json(spark: SparkSession, d: str) -> DataFrame:
    return D.parse_snapshot_json(_versions(spark, d)).select("video_id", "segment_index", "start_ms", F.md5("content").alias("content_md5"))


A7 = with_ctes("segments") + "SELECT video_id, segment_index, start_ms, md5(content) AS content_md5 FROM segments"


def a11_render_markdown(spark: SparkSession, d: str) -> DataFrame:
    m = S.messages(spark, d).groupBy("video_id").agg(F.sort_array(F.collect_list("content")).alias("l"))
    section = F.array(F.struct(F.lit("Turns").alias("heading"), F.col("l").alias("bullets")))
    text = D.render_markdown(F.concat(F.lit("Talk "), F.col("video_id").cast("string")), F.lit(""), F.lit("-"), section, F.array(F.lit("end")), ("Summary", "Sources"))
    return m.select("video_id", F.md5(text).alias("markdown_md5"))


A11 = with_ctes("messages") + r"""SELECT video_id, md5('# Talk ' || video_id || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '-' || chr(10) || chr(10) || '## Turns' || chr(10) || chr(10)
|| string_agg('- ' || content || chr(10), '' ORDER BY content) || chr(10) || '## Sources' || chr(10) || chr(10) || '- end' || chr(10) || chr(10)) AS markdown_md5 FROM messages GROUP BY video_id"""


def a12_content_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("md5"))


A12 = "SELECT page_id, md5(html) AS md5 FROM pages"


def a13_validate_container(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("0000ftyp"), "html")).otherwise(F.col("html")).cast("binary")
    name = F.when(F.col("page_id") % 2 == 0, "a.MP4").otherwise("b.txt")
    return p.select("page_id", D.validate_container(content, name, F.length(content), 8000).alias("verdict"))


A13 = """SELECT page_id, CASE WHEN n > 8000 THEN 'size' WHEN page_id % 2 = 1 THEN 'extension' WHEN page_id % 3 <> 0 THEN 'signature' ELSE 'ok' END AS verdict
FROM (SELECT page_id, octet_length(encode(CASE WHEN page_id % 3 = 0 THEN '0000ftyp' || html ELSE html END)) AS n FROM pages)"""


def b8_glossary_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select((F.col("c_custkey") % 200).cast("string").alias("pattern"), F.lower("c_mktsegment").alias("replacement"), F.col("c_custkey").cast("long").alias("updated"))
    old = c.where("updated % 2 = 0").groupBy("pattern", "replacement").agg(F.max("updated").alias("updated")).withColumn("enabled", F.lit(False))
    return D.glossary_upsert(old, c.where("updated % 2 = 1"))


B8 = """SELECT pattern, replacement, arg_max(updated % 2 = 1, updated) AS enabled, max(updated) AS updated FROM (SELECT CAST(c_custkey % 200 AS VARCHAR) AS pattern, lower(c_mktsegment) AS replacement, CAST(c_custkey AS BIGINT) AS updated FROM customer) GROUP BY 1, 2"""


def b9_context_repair(spark: SparkSession, d: str) -> DataFrame:
    return D.context_repair(S.segments(spark, d), RULES, terms=[]).select("id", F.md5("text").alias("text_md5"))


def _context(src: str) -> str:
    """Steps that end in y(id, video_id, before, plain, y): the texts of src (id, video_id, segment_index, content)
    normalised and mended by RULES; before is the text as it was."""
    return f"""cn AS (SELECT *, {_NORM.format('content')} AS x FROM {src}), cp AS (SELECT *, translate(CASE WHEN {_RISK.format('x')} THEN '' ELSE x END, '妳祢', '你你') AS plain FROM cn),
cj AS (SELECT video_id, string_agg(lower(plain), ' ' ORDER BY segment_index, id) AS j FROM cp GROUP BY 1), cf AS (SELECT video_id, contains(j, 'thand') OR contains(j, 'erst') AS f0,
contains(j, 'ouhe')::INT + contains(j, 'ingth')::INT + contains(j, 'was the')::INT + contains(j, 'zzz')::INT >= 2 AS f1, contains(j, 'that the') OR contains(j, 'nowhere') AS f2 FROM cj),
y0 AS (SELECT cp.*, f1, f2, CASE WHEN f0 THEN replace(plain, 'the and', 'THE-AND') ELSE plain END AS y FROM cp JOIN cf USING (video_id)), y1 AS (SELECT * EXCLUDE (y), CASE WHEN f1 THEN replace(y, 'of the', 'OF-THE') ELSE y END AS y FROM y0),
y AS (SELECT id, video_id, content AS before, plain, CASE WHEN f2 THEN replace(y, 'with the', 'WITH') ELSE y END AS y FROM y1)"""


_SAFE = "y <> '' AND y <> before AND length(y) <= greatest(1, length(plain)) + 24 AND length(y) >= greatest(1, greatest(1, length(plain)) // 3)"
B9 = with_ctes("segments") + f", {_context('segments')} SELECT id, md5(y) AS text_md5 FROM y WHERE {_SAFE}"


def b10_repair_batch(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.struct(T.collapse(c).alias("text"), (T.collapse(c) != c).alias("changed"))
    return D.repair_batch(S.segments(spark, d), RULES, terms=[], glossary=[("erth", "Erth")], repair=clean)[1]


B10 = with_ctes("segments") + f""", e AS (SELECT id, video_id, segment_index, content AS raw, trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS content FROM segments), {_context('e')},
t AS (SELECT y.id, y.video_id, e.raw <> e.content AS changed, {_SAFE} AS mended, CASE WHEN {_SAFE} THEN y ELSE before END AS t FROM y JOIN e USING (id)),
n AS (SELECT *, {_NORM.format('t')} AS x FROM t), p AS (SELECT *, translate(CASE WHEN {_RISK.format('x')} THEN '' ELSE x END, '妳祢', '你你') AS plain FROM n),
g AS (SELECT *, regexp_replace(plain, '(?i)erth', 'Erth', 'g') <> t AS glossed FROM p)
SELECT video_id, count(*) AS scanned, count(*) FILTER (WHERE changed) AS encoding, count(*) FILTER (WHERE mended) AS context, count(*) FILTER (WHERE glossed) AS glossary,
count(*) FILTER (WHERE changed) + count(*) FILTER (WHERE mended) + count(*) FILTER (WHERE glossed) AS repaired, bool_or(changed OR mended OR glossed) AS reindexed FROM g GROUP BY 1"""


def g23_local_summaries(spark: SparkSession, d: str) -> DataFrame:
    return D.local_summaries(S.segments(spark, d), S.videos(spark, d), {"OUTLINE": 220, "POINTS": 180, "HOOKS": 150})


G23 = with_ctes("segments") + r""", t AS (SELECT doc_id AS video_id, coalesce(x, '') AS t FROM documents LEFT JOIN (SELECT video_id, trim(regexp_replace(string_agg(trim(content), ' ' ORDER BY segment_index), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM segments GROUP BY 1) s ON s.video_id = doc_id)
SELECT video_id, type, CASE WHEN t = '' THEN 'no transcript' WHEN length(t) > n THEN substr(t, 1, n - 1) || '…' ELSE t END AS summary FROM t, (VALUES ('OUTLINE', 220), ('POINTS', 180), ('HOOKS', 150)) k(type, n)"""


def g26_version_list(spark: SparkSession, d: str) -> DataFrame:
    return D.version_list(_versions(spark, d)).select("video_id", "version_no", "n_segments", F.length("preview").cast("long").alias("preview_length"))


G26 = with_ctes("segments") + r"""SELECT video_id, CAST(1 AS BIGINT) AS version_no, count(*) AS n_segments, CASE WHEN length(arg_min(c, segment_index)) > 90 THEN 92 ELSE length(arg_min(c, segment_index)) END AS preview_length
FROM (SELECT *, trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c FROM segments) GROUP BY 1"""

QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "abg" and k[1:2].isdigit()}
ORACLES = {k: globals()[o] for k in QUERIES if (o := k.split("_")[0].upper()) in globals()}
