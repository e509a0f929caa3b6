"""Text functions as column expressions; all of them stay in the JVM. A null text gives null unless said otherwise."""

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{IsAlphabetic}\p{N}]+"

# Words that say nothing about a query's subject.
STOP = ("what which who when where how why many on during after according did does was were are is we record about say the and for with from that this into have has our its "
        "para com sem uma um que dos das por qual quais quem quando onde como era eram foi foram esta estao aconteceu do da no na nos nas ao aos em de se os as o a e").split()
# Words left out of answers' concepts.
GENERATOR_STOP = ("this that with from have were what about para como qual quais sobre porque where when plan note notes they them into your will more http https localhost source startline "
                  "score lines").split()
# What marks a question about past events, or about a document.
RECALL = ["what did we record", "what did we", "o que decidimos", "relembre", "lembramos"]
LOOKUP = ["what does", " say", " say?", " file", " files", " path", " paths", "where is", "where are", "which file", "which files", "which doc", "profile", "catalog", "catalogo", " guide", "guia",
          "protocol", "protocolo"]
# Groups of words that count as one term of a query.
GROUPS = [g.split() for g in (
    "plano plan planejamento planning", "converter conversao convert conversion converting", "cliente clientes client clients customer customers", "pagante pagantes paying paid payer payers",
    "venda vendas sale sales", "decisao decisoes decision decisions", "lancamento launch launching", "juridico juridica legal", "advogado advogados lawyer lawyers attorney attorneys",
    "prioridade prioridades priority priorities", "rank ranks ranked ranking ranquear ranqueou ranqueado", "promote promotes promoted promotion promover promoveu promocao",
    "candidate candidates candidato candidatos", "opportunity opportunities oportunidade oportunidades", "revenue receita receitas", "review reviews revisao revisoes",
    "finance financial financials financeiro financeira", "ingest ingestion ingestao", "deadline prazo")]
# Names of months.
MONTHS = [m.split() for m in ("jan january janeiro", "feb february fevereiro", "mar march marco", "apr april abril", "may maio", "jun june junho", "jul july julho", "aug august agosto",
                              "sep sept september setembro", "oct october outubro", "nov november novembro", "dec december dezembro")]


def _folding() -> tuple[str, str]:
    """What translate() needs to take accents off Latin, Greek and Cyrillic letters and to drop combining marks."""
    src, dst, marks = [], [], []
    for k in range(0x80, 0x2000):
        c = chr(k)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            src.append(c)
            dst.append(base)
    return "".join(src + marks), "".join(dst)


_FROM, _TO = _folding()
assert sys.maxunicode > 0xFFFF


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, _FROM, _TO))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def folded_tokens(c: Column) -> Column:
    return tokens(fold(c))


def is_stop(term: Column) -> Column:
    return term.isin(STOP)


def exact_terms(c: Column) -> Column:
    """Folded tokens of at least two bytes that are no stop words; order and repetitions stay."""
    return F.filter(folded_tokens(c), lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP))


def generator_terms(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: (F.octet_length(t) >= 4) & ~t.isin(GENERATOR_STOP))


def _any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def recall_intent(c: Column) -> Column:
    return _any(fold(c), RECALL)


def query_mode(c: Column) -> Column:
    return F.when(_any(fold(c), LOOKUP), "lookup").when(recall_intent(c), "recall").otherwise("concept")


def alternatives(term: Column) -> Column:
    """The group of words that the term belongs to, else the term alone."""
    out = F.array(term)
    for g in GROUPS:
        out = F.when(term.isin(g), F.array(*[F.lit(x) for x in g])).otherwise(out)
    return out


def date_parts(c: Column) -> Column:
    """STRUCT<year, month, day>: the first three numbers in a row that make a date, else a month's name with a day near it.

    The day is the nearest of three tokens before the name, else of three after; the year any number from 1900 to 2100, or null.
    Null if there is no date.
    """
    month = F.lit(None).cast("int")

    def number(t: Column) -> Column:
        out = month
        for k, names in enumerate(MONTHS):
            out = F.when(t.isin(names), k + 1).otherwise(out)
        return out

    def as_int(t: Column) -> Column:
        return F.when(t.rlike("^[0-9]{1,9}$"), t).try_cast("int")

    def day(t: Column) -> Column:
        return F.when(as_int(t).between(1, 31), as_int(t))

    def find(toks: Column, nums: Column) -> Column:
        full = F.filter(F.transform(nums, lambda n, i: F.struct(n.alias("year"), F.get(nums, i + 1).alias("month"), F.get(nums, i + 2).alias("day"))),
                        lambda d: d["year"].between(1900, 2100) & d["month"].between(1, 12) & d["day"].between(1, 31))
        year = F.get(F.filter(nums, lambda n: n.between(1900, 2100)), F.lit(0))
        named = F.filter(F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin([n for m in MONTHS for n in m]))
        dated = F.filter(F.transform(named, lambda x: F.struct(year.alias("year"), number(x["t"]).alias("month"), F.coalesce(
            *[F.when(x["i"] + k >= 0, day(F.get(toks, x["i"] + k))) for k in (-1, -2, -3, 1, 2, 3)]).alias("day"))), lambda d: d["day"].isNotNull())
        return F.coalesce(F.get(full, F.lit(0)), F.get(dated, F.lit(0)))

    # A one-element transform binds its value, so that the text is cut into tokens once and not for each of them.
    numbers = lambda ts: F.filter(F.transform(ts, as_int), lambda n: n.isNotNull())
    return F.get(F.transform(F.array(folded_tokens(c)), lambda ts: F.get(F.transform(F.array(numbers(ts)), lambda ns: find(ts, ns)), F.lit(0))), F.lit(0))


def date_ordinal(d: Column) -> Column:
    """A number that orders dates; of a date with a year only."""
    return d["year"].cast("bigint") * 372 + d["month"] * 31 + d["day"]


def strip_date_prefix(c: Column) -> Column:
    dated = c.rlike(r"^[0-9]{4}-[0-9]{0,2}-[0-9]{0,2}-")
    return F.when(dated, F.replace(F.regexp_replace(c, r"^[0-9]{4}-[0-9]{0,2}-[0-9]{0,2}-", ""), F.lit("-"), F.lit(" "))).otherwise(F.translate(c, "-_", "  "))


def clean_sentence(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.trim(c), r"^[#\-*> ]+", ""))
    s = F.regexp_replace(F.regexp_replace(s, "^`+|`+$", ""), '^"+|"+$', "")
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def sentence_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}\s]", "")


def evidence_text(c: Column, nav: str = "nav", hub: str = "hub") -> Column:
    """Without frontmatter, navigation blocks and hub marks; runs of blank lines become one, line ends are trimmed."""
    s = F.regexp_replace(c, r"\r\n", "\n")
    s = F.regexp_replace(s, r"\A\s*---\n(?:(?!---[ \t]*\n).*\n)*---[ \t]*(?:\n|\z)", "")
    s = F.regexp_replace(s, rf"(?m)^[ \t]*<!-- {nav}:start -->[ \t]*\n(?:.*\n)*?[ \t]*<!-- {nav}:end -->[ \t]*(?:\n|\z)", "")
    s = F.regexp_replace(s, rf"(?m)^[ \t]*<!-- {hub}:(?:start|end) -->[ \t]*(?:\n|\z)", "")
    s = F.regexp_replace(s, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def frontmatter(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"\A﻿+", ""), r"\A---\n((?:.*\n)*?)---(?:\n|\z)", 1)


def frontmatter_tags(c: Column) -> Column:
    """The parts of the frontmatter's line `tags:`, folded, sorted, once each."""
    line = F.regexp_extract(fold(frontmatter(F.regexp_replace(c, r"\A\s+", ""))), r"(?m)^\s*tags:(.*)$", 1)
    parts = F.transform(F.split(line, r"[,\[\] ]"), lambda x: F.regexp_replace(x, "^[\"']+|[\"']+$", ""))
    return F.when(c.isNotNull(), F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))))


def hashtags(c: Column) -> Column:
    """Words after a # in the text, in lower case, sorted, once each."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:^|[^\w/])#([\wÀ-ÿ][\wÀ-ÿ/-]*)"), F.lit(1)), lambda x: F.lower(x))))


def wikilinks(c: Column) -> Column:
    """ARRAY<STRUCT<target, display, anchor>> of the double-bracket links. The anchor may stand on either side of the bar."""
    raw = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")

    def parse(x: Column) -> Column:
        left, right = F.regexp_extract(x, r"(?s)^([^|]*)", 1), F.when(F.contains(x, F.lit("|")), F.regexp_extract(x, r"(?s)^[^|]*\|(.*)$", 1))
        a = F.when(F.contains(left, F.lit("#")), F.trim(F.regexp_extract(left, r"(?s)^[^#]*#(.*)$", 1)))
        b = F.when(a.isNull() & F.contains(right, F.lit("#")), F.trim(F.regexp_extract(right, r"(?s)^[^#]*#(.*)$", 1)))
        shown = F.when(a.isNull() & F.contains(right, F.lit("#")), F.regexp_extract(right, r"(?s)^([^#]*)", 1)).otherwise(right)
        return F.struct(F.trim(F.regexp_extract(left, r"(?s)^([^#]*)", 1)).alias("target"), F.trim(shown).alias("display"), F.coalesce(a, b).alias("anchor"))

    return F.transform(raw, parse)


def canonical_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.replace(c, F.lit("\\"), F.lit("/")))), r"\.md$", ""), "^/+|/+$", "")


def file_stem(c: Column) -> Column:
    """The last part of a path without its last extension; a name that begins with its only dot stays whole."""
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def path_stem(c: Column) -> Column:
    """The stem as a link's title would give it: folded, dashes and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.translate(fold(file_stem(c)), "-_", "  "), r"\s+", " "))


def normalize_markdown(c: Column) -> Column:
    """Line feeds only, no no-break spaces, no trailing blanks, no two blank lines in a row, one line feed at the end."""
    s = F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit(" "), F.lit(" "))
    s = F.regexp_replace(F.regexp_replace(s, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(s, r"\A\s+|\s+\z", ""), F.lit("\n"))


def safe_filename(c: Column, fallback: str = "document", longest: int = 120) -> Column:
    s = F.regexp_replace(F.trim(c), r"[^\p{IsAlphabetic}\p{N}\-_. ]", "-")
    s = F.regexp_replace(F.regexp_replace(F.trim(s), " +", "-"), r"^[-._]+|[-._]+$", "")
    return F.lower(F.when(s == "", fallback).otherwise(F.substring(s, 1, longest)))


def slug(c: Column) -> Column:
    s = F.trim(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}_\s\-]", ""))
    return F.when(s == "", "chat").otherwise(s)


def yaml_scalar(c: Column) -> Column:
    s = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), s, F.lit('"'))


def provenance(body: Column, fields: dict[str, Column], prefix: str = "origin_") -> Column:
    """body under a frontmatter that names where it came from; fields with null values are left out."""
    lines = [F.concat(F.lit(f"{prefix}{k}: "), yaml_scalar(v.cast("string"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.coalesce(body, F.lit("")))


def truncated(c: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def recall_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{IsAlphabetic}\p{N}]+", " "), " +", " "))


def contains_recalled(text: Column, term: Column) -> Column:
    """The normalised term is in the normalised text; a term of digits also if they stand there parted by other signs."""
    hay, needle = recall_key(text), recall_key(term)
    digits = F.regexp_replace(needle, "[^0-9]", "")
    return F.contains(hay, needle) | ((digits != "") & needle.rlike(r"^[\p{N} ]+$") & F.contains(F.replace(hay, F.lit(" "), F.lit("")), digits))


def page(c: Column, offset: Column, limit: Column) -> Column:
    """STRUCT<text, start, next_offset, has_more> of a document's page, in characters; limit is taken between 1 and 20,000."""
    n = F.length(c)
    start = F.least(F.greatest(offset, F.lit(0)), n)
    size = F.least(F.greatest(limit, F.lit(1)), F.lit(20_000))
    end = F.least(start + size, n)
    return F.struct(F.substr(c, start + 1, end - start).alias("text"), start.alias("start"), F.when(end < n, end).alias("next_offset"), (end < n).alias("has_more"))


def size_profile(n_bytes: Column) -> Column:
    """STRUCT<tokens, overlap> of chunks for a file of so many bytes."""
    k = 1024
    pair = lambda a, b: F.struct(F.lit(a).alias("tokens"), F.lit(b).alias("overlap"))
    return F.when(n_bytes < 512 * k, pair(512, 64)).when(n_bytes < 2048 * k, pair(1024, 128)).when(n_bytes < 5120 * k, pair(2048, 256)).otherwise(pair(3072, 384))


def project_name(c: Column) -> Column:
    """The path that a project folder's dashed name stands for, without the home folder."""
    parts = F.split(F.regexp_replace(c, "^-+", ""), "-")
    home = F.lower(F.get(parts, F.lit(0))).isin("users", "home")
    return F.array_join(F.when(home & (F.size(parts) > 2), F.slice(parts, 3, F.size(parts))).otherwise(parts), "/")


def html_text(c: Column) -> Column:
    """HTML to light Markdown by a fixed list of replacements."""
    s = c
    for p, to in ((r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<h[1-6][^>]*>", "\n## "), (r"(?i)</h[1-6]>", "\n"), (r"(?i)<li[^>]*>", "\n- "), (r"(?i)</(?:p|div|li|ul|ol|tr)>", "\n"),
                  (r"(?i)</?(?:b|strong)>", "**"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&amp;", "&"), (r"\n{3,}", "\n\n")):
        s = F.regexp_replace(s, p, to)
    return F.trim(s)
