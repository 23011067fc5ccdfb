"""Column expressions on text: tokens, keys, titles, citations, line classes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the stop list, sentence abbreviations, line patterns.
TOKEN = r"[a-z0-9]+(?:[.,/][0-9]+)*[a-z]?"
STOP_WORDS = (
    "a an and are as at be been by can for from has have if in into is it its may of on or "
    "shall such that the their there these this those to under was were which will with"
).split()
ABBREVIATIONS = ["No.", "Rs.", "viz.", "i.e.", "e.g.", "etc.", "Sr.", "Para.", "Ltd.", "Co."]
CHAPTER = r"^(Chapter|CHAPTER)\s*[-–]?\s*([IVXLC]+|\d+)\b\s*[-–—:.]?\s*(.*)$"
ANNEX = r"^(Annex(?:ure)?|Appendix|Schedule)\s*[-–—]?\s*([IVXLC]+|\d+)\b\s*[-–—:.]?\s*([A-Z(\[].*)?$"
PART = r"^(Part|PART)\s+([A-Z]|[IVXLC]+|\d+)\b\s*[-–—:.]?\s*([A-Z(].*)?$"
HEADING = r"^([A-Z]\.(?:\d{1,2}\.?)*)\s+([A-Z(].{2,90})$"
PARAGRAPH = r"^(\d{1,3}(?:\.\d{1,3}){0,3})\.?\s+(\S.*)$"
SUB_PARAGRAPH = r"^\(([a-z]{1,3}|\d{1,3}|[ivxl]{1,6})\)\s+(\S.*)$"
LONE_NUMBER = r"^(\d{1,3}(?:\.\d{1,3}){0,3})\.$"
CONTENTS_LINE = r"(\.\s*){5,}\s*\d+\s*$"
CONTENTS_TITLE = r"(?i)^(table of contents|contents|index)$"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,3}(\s*(of|/)\s*\d{1,3})?\s*$"
CITATION = r"\[(\d+)\]"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def lit_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Search tokens in order: pattern, stop list, then a final "s" off words of five letters and more (not "ss")."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    kept = F.filter(found, lambda t: ~t.isin(*STOP_WORDS))
    return F.transform(kept, lambda t: F.when((F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    """Lower case, plain quotes and dashes, single blanks (compatibility forms: ``functions.python.nfkc`` first)."""
    return collapsed(F.lower(F.translate(text, "‘’“”–—‑", "''\"\"---")))


def cache_key(question: Column) -> Column:
    return F.regexp_replace(collapsed(F.lower(question)), r"[?.! ]+$", "")


def key_span(quote: Column, size: int = 12) -> Column:
    """The middle ``size`` words of a quote."""
    w = words(quote)
    start = F.floor((F.size(w) - size) / 2).cast("int")
    return F.array_join(F.slice(w, F.greatest(start, F.lit(0)) + 1, F.lit(size)), " ")


def short_title(title: Column) -> Column:
    bare = F.trim(F.regexp_replace(title, r"\s*\((?:Updated|updated)[^)]*\)\s*$", ""))
    round_, square = r"^Reserve Bank of India \((.+)\) (?:Supervisory )?(?:Directions|Guidelines)", r"^Reserve Bank of India \[(.+)\] Directions"
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^Master Directions?\s*[-–]?\s*(on\s+)?", ""), r",? dated .*$", ""))
    return F.coalesce(F.nullif(F.regexp_extract(bare, round_, 1), F.lit("")), F.nullif(F.regexp_extract(bare, square, 1), F.lit("")), plain)


def sentences(text: Column) -> Column:
    """Splits after . ; : before a capital, bracket, digit or quote; glues what an abbreviation ended."""
    parts = F.split(text, r"(?<=[.;:])\s+(?=[A-Z(\d‘'\"])")
    ends = "(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")$"
    marked = F.transform(parts, lambda p: F.concat(p, F.when(p.rlike(ends), " ").otherwise("\x01")))  # nothing of the whole text in here: it would be split again for each part
    return F.split(F.regexp_replace(F.array_join(marked, ""), r"(?s).\z", ""), "\x01")  # the last part has no mark


def section_header(*parts: Column) -> Column:
    return F.concat_ws(" > ", *(F.nullif(p, F.lit("")) for p in parts))


def index_text(header: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(header, F.lit("")), text)


def citation(title: Column, chapter: Column, first: Column, last: Column, page: Column, page_end: Column) -> Column:
    """title, chapter, para X | paras X–Y, p. N | pp. A–B."""
    none = F.coalesce(first, F.lit("")) == ""
    paras = F.when(none, F.lit(None)).when(first == last, F.concat(F.lit("para "), first)).otherwise(F.concat(F.lit("paras "), first, F.lit("–"), last))
    pages = F.when(page == page_end, F.concat(F.lit("p. "), page.cast("string"))).otherwise(F.concat(F.lit("pp. "), page.cast("string"), F.lit("–"), page_end.cast("string")))
    return F.concat_ws(", ", title, F.nullif(chapter, F.lit("")), paras, pages)


def repeated_form(line: Column) -> Column:
    """What headers of different pages have in common: lower case, digits as #."""
    return F.trim(F.regexp_replace(F.lower(line), r"(?U)\d+", "#"))


def mostly_non_latin(line: Column, share: float = 0.5) -> Column:
    """Less than ``share`` of the letters are ASCII; false without letters."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    ascii_ = F.length(F.regexp_replace(line, r"[^A-Za-z]", ""))
    return F.when(letters == 0, False).otherwise(ascii_ / letters < share)


def chapter_number(token: Column) -> Column:
    """Decimal, or roman with subtraction."""
    digits = F.split(token, "")
    values = F.create_map(*(x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))))
    nums = F.transform(F.filter(digits, lambda c: c != ""), lambda c: F.coalesce(F.element_at(values, c), F.lit(0)))
    follow = F.concat(F.slice(nums, F.lit(2), F.size(nums)), F.array(F.lit(0)))
    roman = F.aggregate(F.zip_with(nums, follow, lambda a, b: F.when(b > a, -a).otherwise(a)), F.lit(0), lambda x, y: x + y)
    return F.when(token.rlike(r"^\d+$"), token.cast("int")).otherwise(roman)


def cited_numbers(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda n: n.cast("int"))


def checked_citations(answer: Column, listed: Column, n_sources: Column) -> tuple[Column, Column]:
    """(valid, invalid): numbers used in the text or listed, sorted."""
    used = F.array_sort(F.array_distinct(F.concat(cited_numbers(answer), listed)))
    ok = lambda n: (n >= 1) & (n <= n_sources)
    return F.filter(used, ok), F.filter(used, lambda n: ~ok(n))


def parsed_reply(reply: Column) -> Column:
    """struct<found, answer, citations> of the outermost braces; null without JSON. ``found`` is true unless false, 0 or empty;
    any non-empty string is true."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    data = F.from_json(body, "found string, answer string, citations array<string>")
    empty = F.get_json_object(body, "$.found").isin("false", "0", "", "[]", "{}") & ~body.rlike(r'"found"\s*:\s*"[^"]')
    found = F.when(data["found"].isNull() & ~body.rlike(r'"found"\s*:\s*null'), True).when(data["found"].isNull(), False).otherwise(~empty)
    numbers = F.transform(F.filter(F.coalesce(data["citations"], F.array().cast("array<string>")), lambda c: c.rlike(r"^\d+$")), lambda c: c.cast("int"))
    return F.when(body.isNull() | F.from_json(body, "map<string,string>").isNull(), F.lit(None)).otherwise(F.struct(found.alias("found"), F.trim(F.coalesce(data["answer"], F.lit(""))).alias("answer"), numbers.alias("citations")))


def parsed_queries(reply: Column) -> Column:
    """Non-blank strings of the ``queries`` list in the outermost braces; empty for bad JSON."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    found = F.coalesce(F.from_json(body, "queries array<string>")["queries"], F.array().cast("array<string>"))
    blank = r"(?U)^\s+|\s+$"
    return F.filter(F.transform(found, lambda q: F.regexp_replace(q, blank, "")), lambda q: q.isNotNull() & (q != ""))


def daily_limit(status: Column, body: Column) -> Column:
    """A quota that waiting will not bring back today."""
    return (status == 429) & F.lower(body).rlike("per ?day")


def retry_delay(retry_after: Column, attempt: Column) -> Column:
    return F.when(retry_after.isNotNull(), F.least(retry_after + 1, F.lit(90.0))).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(60.0)))


def model_route(name: Column, providers: list[str], default: str) -> tuple[Column, Column]:
    """(provider, model) of "provider:model"; an unknown provider is part of the model's name."""
    head = F.substring_index(name, ":", 1)
    known = name.contains(":") & head.isin(*providers)
    return F.when(known, head).otherwise(F.lit(default)), F.when(known, F.regexp_replace(name, r"^[^:]*:", "")).otherwise(name)


def client_key(forwarded: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), F.nullif(host, F.lit("")), F.lit("?"))


def collection_name(strategy: Column, model: Column) -> Column:
    return F.concat(strategy, F.lit("__"), F.lower(F.element_at(F.split(model, "/"), -1)))


def highlighted(answer: Column) -> Column:
    return F.regexp_replace(answer, CITATION, "**[$1]**")


def html_heading(html: Column) -> Column:
    return collapsed(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", " "))


def html_text(html: Column) -> Column:
    """Visible body text: navigation, header, footer, scripts and styles removed, tags to blanks."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|head)[^>]*>.*?</\1>", " ")
    return collapsed(F.regexp_replace(body, r"(?s)<[^>]*>", " "))
