"""Text functions over columns (parsing, cleaning, links, token estimates, highlights)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOC_ID_SUFFIX = r"_\d+$"
#: CJK ranges counted at 1.5 characters a token.
CJK = "[\u4e00-\u9fff\u3400-\u4dbf\uff00-\uffef\u3000-\u303f]"


def filename_metadata(name: Column) -> Column:
    """`client_project_docType_date.md`: the last three parts, the rest is the client; fewer than four: all empty."""
    parts = F.split(F.regexp_replace(name, r"\.md$", ""), "_", -1)
    n = F.size(parts)
    pick = lambda i: F.when(n >= 4, F.element_at(parts, i)).otherwise("")
    client = F.when(n >= 4, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 3, F.lit(1))), "_")).otherwise("")
    return F.struct(client.alias("client"), pick(-3).alias("project"), pick(-2).alias("docType"), pick(-1).alias("date"))


def title(content: Column, fallback: Column) -> Column:
    """`# x` on the first line; a table, rule, `###` or empty first line defers to the first `# ` line, else the file name."""
    first = F.trim(F.element_at(F.split(content, "\n", -1), 1))
    anywhere = F.trim(F.regexp_extract(content, r"(?m)^# (.+)$", 1))
    deferred = (first == "") | first.startswith("|") | first.startswith("---") | first.startswith("###")
    return F.when(first.startswith("# "), F.trim(F.substring(first, F.lit(3), F.length(first)))).when(deferred, F.when(anywhere != "", anywhere).otherwise(fallback)).otherwise(first)


def wiki_links(content: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(x)))


def strip_links(content: Column) -> Column:
    return F.regexp_replace(content, r"\[\[([^\]]+)\]\]", "$1")


def is_table_line(line: Column) -> Column:
    return F.trim(line).startswith("|") & F.trim(line).endswith("|") & (F.trim(line) != "")


def is_table_block(block: Column) -> Column:
    lines = F.filter(F.split(block, "\n", -1), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 2) & F.forall(lines, is_table_line)


def sections(content: Column) -> Column:
    return F.split(content, r"(?m)(?=^## )", -1)


def sentences(content: Column) -> Column:
    return F.split(content, r"(?<=[。！？])|(?<=\.)\s+(?=[A-Z])|(?<=[!?])\s+(?=[A-Z])", -1)


def clean_steps(content: Column) -> Column:
    """Cleaned text: marks and control characters out, full-width punctuation folded, blank lines collapsed."""
    c = F.regexp_replace(content, "^﻿", "")
    c = F.regexp_replace(c, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, "[​-‍﻿\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("／"), F.lit("/")), "：(?=[A-Za-z0-9])", ":"), "，(?=[0-9])", ",")
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def cleaned(content: Column) -> Column:
    """struct(content, original, cleaned, ratio, warnings) of a document."""
    c = clean_steps(content)
    ratio = F.when(F.length(content) == 0, 0.0).otherwise((F.length(content) - F.length(c)) / F.length(content))
    warnings = F.array_compact(F.array(F.when(ratio > 0.2, "large reduction"), F.when(F.trim(c) == "", "empty")))
    return F.struct(c.alias("content"), F.length(content).alias("original"), F.length(c).alias("cleaned"), ratio.alias("ratio"), warnings.alias("warnings"))


def clean_wiki(content: Column) -> Column:
    """First frequency line out, line ends and blank runs normalised."""
    c = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(c, r"(?s)\A(.*?)(?:^|(?<=\n))[^\n]*出现频次[:：]\s*\d+[^\n]*\n?(.*)\z", "$1$2")
    return F.regexp_replace(F.trim(c), r"\n{3,}", "\n\n")


def estimate_tokens(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.ceil(cjk / 1.5 + (F.length(text) - cjk) / 4).cast("long")


def link_density(content: Column, links: Column) -> Column:
    total = F.aggregate(links, F.lit(0), lambda a, x: a + F.length(x) + 4)
    return F.when(F.length(content) > 0, total / F.length(content)).otherwise(0.0)


def parse_wiki_entry(content: Column, kind: Column) -> Column:
    """struct(category, frequency, definition) of a dictionary article; category falls back to its type."""
    category = F.trim(F.regexp_extract(content, r"(?m)^> ([^|\n]*)\|", 1))
    frequency = F.coalesce(F.regexp_extract(content, r"出现频次[:：]\s*(\d+)", 1).try_cast("int"), F.lit(0))
    definition = F.trim(F.regexp_extract(content, r"(?m)^> 定义[:：]\s*(.+)$", 1))
    return F.struct(F.when(category == "", kind).otherwise(category).alias("category"), frequency.alias("frequency"), definition.alias("definition"))


def entry_context(content: Column) -> Column:
    return F.trim(F.translate(F.substring(content, 1, 200), "\n", " "))


def sanitise_name(name: Column) -> Column:
    return F.translate(name, '\\/:*?"<>|', "_________")


def document_key(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, DOC_ID_SUFFIX, "")


def result_title(path: Column, fallback: Column) -> Column:
    short = F.regexp_replace(F.regexp_replace(path, "^Raw/", ""), r"\.md$", "")
    return F.when(F.coalesce(path, F.lit("")) == "", fallback).otherwise(short)


def round_half_up(x: Column, digits: int = 4) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def session_id(ms: Column, random: Column) -> Column:
    return F.concat(F.lower(F.conv(ms.cast("string"), 10, 36)), random)


def highlight(content: Column, query: Column, before: int = 50, after: int = 300) -> Column:
    """Window around the first query character found, ellipses at cut ends, first hit of every query word in bold."""
    chars = F.filter(F.split(query, ""), lambda c: F.trim(c) != "")
    found = F.filter(F.transform(chars, lambda c: F.instr(F.lower(content), F.lower(c))), lambda p: p > 0)
    anchor = F.coalesce(F.get(found, 0), F.lit(1))
    lo = F.greatest(anchor - before, F.lit(1))
    hi = F.least(anchor + after, F.length(content) + 1)
    window = F.substring(content, lo, hi - lo)

    def bold(text: Column, word: Column) -> Column:
        at = F.instr(F.lower(text), F.lower(word))
        n = F.length(word)
        return F.when((at > 0) & (n > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit("**"), F.substring(text, at, n), F.lit("**"), F.substring(text, at + n, F.length(text)))).otherwise(text)

    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    return F.concat(F.when(lo > 1, "...").otherwise(""), F.aggregate(words, window, bold), F.when(hi <= F.length(content), "...").otherwise(""))
