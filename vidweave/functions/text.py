"""Column functions over transcript text: cleaning, repair, terms, formats and question rules.

All take and return Columns built from Spark functions. Lengths count code points. Word lists, rules and
patterns are parameters with defaults."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that hint at a wrongly decoded text.
SUSPICIOUS_LATIN = "ÃÂåæçèéð"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
#: Spoken forms of technical terms and what they stand for, in order of use.
TERM_RULES: list[tuple[str, str]] = [
    (r"(?iu)(?<![A-Za-z])my\s+sql(?![A-Za-z])", "MySQL"),
    (r"(?iu)(?<![A-Za-z])my\s+sequel(?![A-Za-z])", "MySQL"),
    (r"(?iu)(?<![A-Za-z])my\s+batis(?![A-Za-z])", "MyBatis"),
    (r"(?iu)(?<![A-Za-z])my\s+battis(?![A-Za-z])", "MyBatis"),
    (r"(?iu)(?<![A-Za-z])red\s+is(?![A-Za-z])", "Redis"),
    (r"(?iu)(?<![A-Za-z])ray\s+dis(?![A-Za-z])", "Redis"),
    (r"(?iu)瑞迪斯|雷迪斯", "Redis"),
    (r"(?iu)(?<![A-Za-z])ready\s+son(?![A-Za-z])", "Redisson"),
    (r"(?iu)(?<![A-Za-z])red\s+is\s+son(?![A-Za-z])", "Redisson"),
    (r"(?iu)(?<![A-Za-z])set\s*n\s*x(?![A-Za-z])", "SETNX"),
    (r"(?iu)(?<![A-Za-z])deep\s+seek(?![A-Za-z])", "DeepSeek"),
    (r"(?iu)(?<![A-Za-z])deep\s+sick(?![A-Za-z])", "DeepSeek"),
    (r"(?iu)(?<![A-Za-z])q\s*wen(?![A-Za-z])", "Qwen"),
    (r"(?iu)(?<![A-Za-z])q\s*drant(?![A-Za-z])", "Qdrant"),
    (r"(?iu)(?<![A-Za-z])queue\s*drant(?![A-Za-z])", "Qdrant"),
    (r"(?iu)(?<![A-Za-z])chat\s*g\s*p\s*t(?![A-Za-z])", "ChatGPT"),
    (r"(?iu)(?<![A-Za-z])chat\s*gbt(?![A-Za-z])", "ChatGPT"),
    (r"(?iu)(?<![A-Za-z])claude\s*code(?![A-Za-z])", "Claude Code"),
    (r"(?iu)(?<![A-Za-z])cloud\s*code(?![A-Za-z])", "Claude Code"),
    (r"(?iu)克劳德\s*(code|代码|扣的)", "Claude Code"),
    (r"(?iu)(?<![A-Za-z])code\s*ex(?![A-Za-z])", "Codex"),
    (r"(?iu)(?<![A-Za-z])code\s*x(?![A-Za-z])", "Codex"),
    (r"(?iu)(?<![A-Za-z])dock\s*er(?![A-Za-z])", "Docker"),
    (r"(?iu)(?<![A-Za-z])spring\s+boot(s)?(?![A-Za-z])", "Spring Boot"),
    (r"(?iu)(?<![A-Za-z])spring\s+cloud(s)?(?![A-Za-z])", "Spring Cloud"),
    (r"(?iu)(?<![A-Za-z])rocket\s*m\s*q(?![A-Za-z])", "RocketMQ"),
    (r"(?iu)(?<![A-Za-z])rocket\s+queue(?![A-Za-z])", "RocketMQ"),
    (r"(?iu)(?<![A-Za-z])rabbit\s*m\s*q(?![A-Za-z])", "RabbitMQ"),
    (r"(?iu)(?<![A-Za-z])message\s+queue(?![A-Za-z])", "MQ"),
    (r"(?iu)(?<![A-Za-z])im\s*bedding(?![A-Za-z])", "Embedding"),
    (r"(?iu)(?<![A-Za-z])embed\s+ding(?![A-Za-z])", "Embedding"),
    (r"(?iu)(?<![A-Za-z])re\s*rank(?![A-Za-z])", "Rerank"),
    (r"(?iu)(?<![A-Za-z])vector\s+database(?![A-Za-z])", "Vector Database"),
    (r"(?iu)(?<![A-Za-z])a\s*[.-]?\s*p\s*[.-]?\s*i(?![A-Za-z])", "API"),
    (r"(?iu)(?<![A-Za-z])a\s*[.-]?\s*s\s*[.-]?\s*r(?![A-Za-z])", "ASR"),
    (r"(?iu)(?<![A-Za-z])o\s*[.-]?\s*c\s*[.-]?\s*r(?![A-Za-z])", "OCR"),
    (r"(?iu)(?<![A-Za-z])r\s*[.-]?\s*a\s*[.-]?\s*g(?![A-Za-z])", "RAG"),
    (r"(?iu)(?<![A-Za-z])l\s*[.-]?\s*l\s*[.-]?\s*m(?![A-Za-z])", "LLM"),
    (r"(?iu)(?<![A-Za-z])a\s*i\s*agent(?![A-Za-z])", "AI Agent"),
    (r"(?iu)(?<![A-Za-z])aigent(?![A-Za-z])", "AI Agent"),
    (r"(?iu)(?<![A-Za-z])ai[-\s]*zen(?![A-Za-z])", "AI Agent"),
    (r"(?iu)(?<![A-Za-z])j\s*[.-]?\s*v\s*[.-]?\s*m(?![A-Za-z])", "JVM"),
    (r"(?iu)(?<![A-Za-z])j\s*[.-]?\s*d\s*[.-]?\s*k(?![A-Za-z])", "JDK"),
    (r"(?iu)(?<![A-Za-z])s\s*[.-]?\s*q\s*[.-]?\s*l(?![A-Za-z])", "SQL"),
    (r"(?iu)(?<![A-Za-z])g\s*[.-]?\s*c(?![A-Za-z])", "GC"),
    (r"(?iu)(?<![A-Za-z])o\s*[.-]?\s*o\s*[.-]?\s*m(?![A-Za-z])", "OOM"),
    (r"(?iu)(?<![A-Za-z])c\s*[.-]?\s*a\s*[.-]?\s*s(?![A-Za-z])", "CAS"),
    (r"(?iu)(?<![A-Za-z])a\s*[.-]?\s*q\s*[.-]?\s*s(?![A-Za-z])", "AQS"),
]


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def text_quality(c: Column, traditional: str = "") -> Column:
    """Counts of suspect characters and the risk that the text is garbled."""
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("long")
    n_repl, n_ctrl, latin, cjk = count("�"), count(CONTROL), count(f"[{SUSPICIOUS_LATIN}]"), count(CJK)
    old = count(f"[{traditional}]") if traditional else F.lit(0).cast("long")
    risk = (n_repl > 0) | (n_ctrl > 0) | ((F.length(c) >= 12) & (latin > 2 * cjk) & (latin > 6))
    return F.struct(n_repl.alias("replacement"), n_ctrl.alias("control"), latin.alias("latin"), old.alias("traditional"), cjk.alias("cjk"), risk.alias("garbled_risk"))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is computed once however often f names it: a projection would be folded back into each use."""
    return F.get(F.transform(F.array(c), f), 0)


def garbled(c: Column) -> Column:
    return text_quality(c)["garbled_risk"]


def _n_of(c: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{characters}]", ""))


def _latin_risk(c: Column) -> Column:
    """garbled, of a text without control and replacement characters; the costly count comes last."""
    latin = _n_of(c, SUSPICIOUS_LATIN)
    return (F.length(c) >= 12) & (latin > 6) & (latin > 2 * F.regexp_count(c, F.lit(CJK)))


def normalize_text(c: Column, simplify: tuple[str, str] = ("", "")) -> Column:
    """White space and control characters cleaned; a garbled text becomes empty; characters mapped."""
    plain = collapse(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[﻿�]", " "), CONTROL, " "))
    kept = bound(plain, lambda x: F.when(_latin_risk(x), F.lit("")).otherwise(x))
    return F.translate(F.translate(kept, *simplify) if simplify[0] else kept, "妳祢", "你你")


def redecoded(c: Column) -> Column:
    """Read as Latin-1 bytes and decoded as UTF-8, bad bytes replaced."""
    return F.make_valid_utf8(F.encode(F.regexp_replace(c, r"[^\x00-\xFF]", "?"), "ISO-8859-1").cast("string"))


def repair_encoding(c: Column, only_if_cjk_gain: bool = False) -> Column:
    """A struct of text and changed: the re-decoded text where it has more CJK or fewer suspect characters."""
    n_cjk = lambda x: F.regexp_count(x, F.lit(CJK))
    suspect = SUSPICIOUS_LATIN + "�"

    def chosen(s: Column) -> Column:
        better = s["again"].rlike(CJK) & (n_cjk(s["again"]) > n_cjk(s["plain"]))
        if not only_if_cjk_gain:
            better = better | (_n_of(s["again"], suspect) < _n_of(s["plain"], suspect))
        return F.when((s["again"] != s["plain"]) & (s["again"] != "") & better, s["again"]).otherwise(s["plain"])

    text = F.coalesce(c, F.lit(""))
    both = F.struct(normalize_text(c).alias("plain"), normalize_text(redecoded(text)).alias("again"))
    # an ASCII text decodes to itself, and no risk is left in it once its control characters are gone
    ascii_only = collapse(F.when(text.rlike(CONTROL), F.regexp_replace(text, CONTROL, " ")).otherwise(text))
    repaired = F.when(text.rlike(r"[^\x00-\x7F]"), bound(both, chosen)).otherwise(ascii_only)
    return bound(repaired, lambda x: F.struct(x.alias("text"), (x != text).alias("changed")))


def _any_of(patterns: list[str], before: str = r"(?iu)(?<![A-Za-z])", after: str = r"(?![A-Za-z])") -> str:
    """One pattern that finds what any of them finds; those between non-letters share one look to the side."""
    between = [p[len(before) : -len(after)] for p in patterns if p.startswith(before) and p.endswith(after)]
    rest = [f"(?:{p})" for p in patterns if not (p.startswith(before) and p.endswith(after))]
    return "|".join(([f"(?:{before}(?:{'|'.join(between)}){after})"] if between else []) + rest)


def correct_terms(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Ordered regex rules, skipped for texts in which none can match."""
    rules = TERM_RULES if rules is None else rules
    if not rules:
        return collapse(c)
    fixed = lambda text: reduce(lambda x, r: F.regexp_replace(x, r[0], r[1].replace("\\", "\\\\").replace("$", "\\$")), rules, text)
    any_rule = _any_of([p for p, _ in rules])
    return bound(c, lambda text: F.when(text.rlike(any_rule), collapse(fixed(text))).otherwise(collapse(text)))


def normalize_transcript(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return correct_terms(normalize_text(c), rules)


def repair_transcript(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    text = correct_terms(repair_encoding(c)["text"], rules)
    return bound(text, lambda x: F.struct(x.alias("text"), (x != F.coalesce(c, F.lit(""))).alias("changed")))


def token_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 2)).cast("long")


def apply_glossary(c: Column, entries: list[tuple[str, str]]) -> Column:
    """entries: (pattern, replacement) of the enabled ones, newest first; replacements are literal."""
    return normalize_text(reduce(lambda x, e: F.regexp_replace(x, "(?iu)" + e[0], e[1].replace("\\", "\\\\").replace("$", "\\$")), entries, normalize_text(c)))


def literal_pattern(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def compact_text(c: Column, n: int, ellipsis: str = "…", cut: int | None = None) -> Column:
    """At most n characters: longer texts keep `cut` (n - 1) and get the ellipsis."""
    x = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1 if cut is None else cut), F.lit(ellipsis))).otherwise(x)


def format_time(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))


def parse_time_range(c: Column) -> Column:
    """(start_ms, end_ms) of the first mm:ss-mm:ss in a text; null if there is none."""
    p = r"(\d+):(\d{2})\s*-\s*(\d+):(\d{2})"
    part = lambda k: F.regexp_extract(c, p, k).try_cast("long")
    return F.struct((part(1) * 60000 + part(2) * 1000).alias("start_ms"), (part(3) * 60000 + part(4) * 1000).alias("end_ms"))


def canonical_url(c: Column) -> Column:
    found = F.regexp_extract(c, r"https?://\S+", 0)
    url = F.regexp_replace(F.when(found != "", found).otherwise(F.trim(c)), r"[\])}>,.;!?，。；！？、）】》]+$", "")
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def platform(url: Column, roots: dict[str, str]) -> Column:
    host = host_of(url)
    return reduce(lambda x, r: F.when((host == r[0]) | host.endswith("." + r[0]), r[1]).otherwise(x), reversed(roots.items()), F.lit("unsupported"))


def classify_failure(c: Column, rules: list[tuple[str, list[str]]], other: str = "other", tail: int = 500) -> Column:
    """The class of the first rule with a needle in the last `tail` characters."""
    text = F.lower(collapse(F.right(F.coalesce(c, F.lit("")), F.lit(tail))))
    return first_rule(text, rules, F.lit(other))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], other: Column) -> Column:
    hit = lambda needles: reduce(lambda a, b: a | b, [text.contains(n) for n in needles])
    return reduce(lambda x, r: F.when(hit(r[1]), F.lit(r[0])).otherwise(x), reversed(rules), other)


def sanitize_filename(c: Column, default: str = "video.bin") -> Column:
    base = F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(base, "[^a-zA-Z0-9._-]", "_")
    return F.when(F.trim(clean) == "", F.lit(default)).otherwise(clean)


def mask_secret(c: Column) -> Column:
    return F.concat(F.lit("****"), F.right(c, F.lit(4)))


#: Questions that are turned away, by reason, in order.
GUARDRAILS: list[tuple[str, list[str]]] = [
    ("instruction override", ["ignore previous", "ignore above", "ignore all previous", "ignore the rules", "disregard previous", "忽略上面的规则", "忽略之前的规则", "忽略规则", "无视规则", "不要遵守"]),
    ("citation bypass", ["不要引用", "不需要引用", "绕过引用", "伪造引用", "伪造时间戳", "编一个时间戳", "without citation", "do not cite", "fake citation", "fake timestamp"]),
    ("prompt leakage", ["输出系统提示", "显示系统提示", "泄露系统提示", "泄露提示词", "reveal system prompt", "show system prompt", "print system prompt", "developer message"]),
    ("permission bypass", ["访问其他用户", "读取其他用户", "越权访问", "bypass permission", "other user's videos", "other users videos"]),
]


def guardrail(c: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    return bound(F.lower(F.trim(c)), lambda text: first_rule(text, rules or GUARDRAILS, F.lit(None).cast("string")))


#: What marks the kinds of questions.
GREETINGS = ["你好", "您好", "你好呀", "你好啊", "hello", "hi", "嗨", "哈喽", "在吗", "在不在"]
INTRO = ["介绍一下你自己", "介绍你自己", "你是谁", "你是什么", "你叫什么", "你能做什么", "你有什么功能", "你会做什么", "你能干什么", "能干什么", "有什么功能", "whoareyou", "whatcanyoudo", "help"]
FOLLOW_ANY = ["上一轮", "上一个", "刚才", "前面", "上面", "前一个"]
FOLLOW_START = ["继续", "接着", "展开", "详细说", "详细解释", "再说说"]
FOLLOW_SHORT = ["这个", "那个", "它", "他", "呢", "为什么"]
FOLLOW_EXACT = ["continue", "goon", "elaborate", "tellmemore", "more", "why", "whyisthat"]
COMPARISON = ["对比", "比较", "差异", "不同", "多个视频", "各个视频", "观点", "compare", "comparison", "difference"]
_STRIP = r"[\s\p{Punct}，。！？、：；“”‘’（）【】《》]+"


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles], F.lit(False))


def question_intent(c: Column) -> Column:
    def kind(s: Column) -> Column:
        low, bare = s["low"], s["bare"]
        follow = contains_any(bare, FOLLOW_ANY) | reduce(lambda a, b: a | b, [bare.startswith(x) for x in FOLLOW_START])
        follow = follow | ((F.length(bare) <= 12) & ~bare.contains("视频") & contains_any(bare, FOLLOW_SHORT)) | bare.isin(FOLLOW_EXACT)
        return (
            F.when((F.length(bare) <= 10) & bare.isin(GREETINGS), "GREETING").when(contains_any(bare, INTRO), "INTRO").when(follow, "FOLLOW_UP")
            .when(contains_any(low, COMPARISON), "COMPARISON").otherwise("NORMAL")
        )

    low = F.lower(c)
    return bound(F.struct(low.alias("low"), F.regexp_replace(low, _STRIP, "").alias("bare")), kind)


#: Groups of triggers and the tokens they add.
DOMAIN_TOKENS: list[tuple[list[str], list[str]]] = [
    (["asr", "字幕", "语音", "转写", "识别", "transcription", "speech"], ["asr", "transcription", "speech", "subtitle", "audio"]),
    (["总结", "摘要", "纪要", "大纲", "summary", "generation"], ["summary", "generation", "outline", "minutes"]),
    (["音频", "抽音频", "audio", "extraction"], ["audio", "extraction", "ffmpeg"]),
    (["上传", "文件", "upload"], ["upload", "file", "video"]),
    (["缓存", "redis", "限流", "进度"], ["redis", "cache", "rate", "progress"]),
    (["mysql", "数据库", "事务", "索引"], ["mysql", "database", "transaction", "index", "status"]),
    (["agent", "rag", "问答", "引用", "时间戳"], ["agent", "rag", "answer", "citation", "timestamp"]),
]
#: Words that a query drops, and what it adds for a trigger.
QUERY_STOP_WORDS = [
    "the", "and", "for", "with", "where", "which", "what", "when", "who", "how", "clips", "clip", "video", "videos", "mention", "mentioned", "mentions", "knowledge", "base", "please", "cite", "show", "tell", "about", "from", "that", "this", "are", "is", "in", "on", "of", "to",
]
QUERY_SYNONYMS: list[tuple[list[str], list[str]]] = [
    (["mysql", "my sql", "数据库"], ["mysql", "my sql", "sql", "database", "status"]),
    (["redis", "缓存", "进度"], ["redis", "readies", "cache", "progress"]),
    (["asr", "字幕", "语音"], ["asr", "subtitle", "audio", "speech"]),
    (["上传", "文件"], ["upload", "file", "video"]),
    (["agent", "rag", "问答"], ["agent", "rag", "answer", "question"]),
]
KB_SYNONYMS: list[tuple[list[str], list[str]]] = [
    (["mysql", "数据库"], ["mysql", "sql", "事务", "索引"]),
    (["redis", "缓存"], ["redis", "缓存", "锁", "限流"]),
    (["字幕", "asr", "ocr"], ["字幕", "asr", "ocr", "识别"]),
    (["agent", "rag", "向量"], ["agent", "rag", "向量", "检索", "引用"]),
]
_EMPTY = lambda: F.array().cast("array<string>")


def tokenize(c: Column) -> Column:
    """Latin and digit runs of two or more, CJK runs of up to six, and the bigrams of CJK runs."""
    low = F.lower(F.coalesce(c, F.lit("")))
    latin = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1), lambda x: F.length(x) >= 2)
    block = F.regexp_extract_all(low, F.lit("([一-龥]+)"), 1)
    grams = lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(_EMPTY())
    cjk = F.flatten(F.transform(block, lambda x: F.concat(F.when(F.length(x) <= 6, F.array(x)).otherwise(_EMPTY()), grams(x))))
    return F.concat(latin, cjk)


def expand(c: Column, tokens: Column, groups: list[tuple[list[str], list[str]]]) -> Column:
    """tokens, and those of each group with a trigger in the text."""
    low = F.lower(c)
    return F.concat(tokens, *[F.when(contains_any(low, on), F.array(*map(F.lit, add))).otherwise(_EMPTY()) for on, add in groups])


def java_hash(token: Column) -> Column:
    """The 31-based string hash, as unsigned 32 bits (basic-plane characters)."""
    return F.aggregate(F.split(token, ""), F.lit(0).cast("long"), lambda a, x: (a * 31 + F.ascii(x)).bitwiseAND(F.lit(4294967295)))


def hash_bucket(token: Column, dim: int = 256) -> Column:
    return (java_hash(token).bitwiseAND(F.lit(0x7FFFFFFF)) % dim).cast("int")


def query_terms(c: Column, stop: list[str] | None = None, synonyms: list[tuple[list[str], list[str]]] | None = None) -> Column:
    """Terms of a question; repeated ones stay and count again."""
    raw = F.split(F.lower(c), "[^a-z0-9一-龥]+")
    stop = QUERY_STOP_WORDS if stop is None else stop
    return expand(c, F.filter(raw, lambda x: (F.length(x) >= 2) & ~x.isin(stop)), QUERY_SYNONYMS if synonyms is None else synonyms)


def kb_query_terms(c: Column, synonyms: list[tuple[list[str], list[str]]] | None = None) -> Column:
    raw = F.filter(F.split(F.lower(c), "[^a-z0-9一-龥]+"), lambda x: F.length(x) >= 2)
    return F.array_distinct(expand(c, raw, KB_SYNONYMS if synonyms is None else synonyms))


def keyword_score(text: Column, terms: Column) -> Column:
    low = F.lower(text)
    return F.aggregate(F.filter(terms, lambda t: low.contains(t)), F.lit(0), lambda a, t: a + F.when(F.length(t) >= 5, 2).otherwise(1)).cast("long")


def kb_score(text: Column, terms: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.aggregate(F.filter(terms, lambda t: (F.trim(t) != "") & low.contains(F.lower(t))), F.lit(0), lambda a, t: a + F.greatest(F.lit(2), F.length(t))).cast("long")
