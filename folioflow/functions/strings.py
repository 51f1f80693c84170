"""Text and JSON columns: normal forms, families, digests, records inside noisy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]+"


def trimmed(text: Column) -> Column:
    """Without white space (29 code points) at either end."""
    return F.regexp_replace(text, f"^{_WHITE}|{_WHITE}$", "")


def collapsed_white(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, _WHITE, " "))


def without_stops(text: Column, stops: tuple[str, ...] = ("<|end|>", "<|endoftext|>")) -> Column:
    """A decoded text without its closing stop marks and outer white space."""
    marks = "|".join(s.replace("|", "\\|") for s in stops)
    return trimmed(F.regexp_replace(text, f"({marks})+$", ""))


def without_tail(ids: Column, stops: list[int]) -> Column:
    """An array without the elements of a set at its end."""
    kept = F.aggregate(F.reverse(ids), F.struct(F.lit(True).alias("tail"), F.lit(0).alias("n")), lambda s, x: F.struct((s["tail"] & x.isin(*stops)).alias("tail"), (s["n"] + (s["tail"] & x.isin(*stops)).cast("int")).alias("n")), lambda s: s["n"])
    return F.slice(ids, 1, F.size(ids) - kept)


def numbers(text: Column) -> Column:
    """The numbers of a text, in order, as written."""
    return F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:[.,]\d+)*)"), 1)


def document_family(name: Column) -> Column:
    """The document of a page's name: what precedes a page or slide number, else the name."""
    found = F.regexp_extract(name, r"^(.+?)[_-](?:page|slide|p)[_-]?\d+(?:\.\w+)?$", 1)
    return F.when(found != "", found).otherwise(name)


def deck_family(name: Column) -> Column:
    """The document of a page's name, with all pages of a slide deck (``deck_page_12.png``) as one."""
    base = document_family(name)
    deck = F.regexp_extract(base, r"^(.*)_page_\d+\.[^.]+$", 1)
    return F.when(base.rlike(r"^.*_page_\d+\.[^.]+$"), deck).otherwise(base)


def stage_name(key: Column) -> Column:
    """``decode.12.x`` as ``decode.*.x``."""
    return F.regexp_replace(key, r"decode\.\d+\.", "decode.*.")


def unix_path(path: Column) -> Column:
    """``C:\\a\\b`` as ``/c/a/b``; other paths with forward slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.rlike("^[A-Za-z]:/"), F.concat(F.lit("/"), F.lower(F.substring(slashed, 1, 1)), F.substring(slashed, 3, 1 << 20))).otherwise(slashed)


def token_number(token: Column) -> Column:
    """The number in ``token_id:123``."""
    return F.nullif(F.regexp_extract(token, r"^token_id:(\d+)$", 1), F.lit("")).cast("int")


def assignments(text: Column) -> Column:
    """Lines ``NAME:TYPE=VALUE`` as a map; comments and other lines are skipped, the last of equal names wins."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"^[^#/:=\s][^:=]*:[A-Z]+=.*$"))
    last = F.transform(F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, "^([^:=]+):", 1))), lambda k: F.struct(k.alias("k"), F.element_at(F.transform(F.filter(lines, lambda x: F.startswith(x, F.concat(k, F.lit(":")))), lambda x: F.regexp_extract(x, "^[^:=]+:[A-Z]+=(.*)$", 1)), -1).alias("v")))
    return F.map_from_entries(last)


def last_json_line(text: Column) -> Column:
    """The last line that begins with a brace."""
    return F.get(F.reverse(F.filter(F.split(text, "\n"), lambda x: x.startswith("{"))), F.lit(0))


def markdown_links(text: Column) -> Column:
    """Link targets inside a repository: no web, mail or fragment links, fragments cut off."""
    found = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), 1)
    local = F.filter(found, lambda x: ~x.rlike("^(https?:|mailto:|#)"))
    return F.transform(local, lambda x: F.substring_index(x, "#", 1))


def differing_flags(values: dict[str, Column], defaults: dict) -> Column:
    """``--name=value`` for each setting that differs from its default."""
    flags = [F.when(~c.eqNullSafe(F.lit(defaults[k])), F.concat(F.lit(f"--{k}="), c.cast("string"))) for k, c in values.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long")).cast("long")


def assembled(blocks: Column) -> Column:
    """Ordered text of blocks (kind, order, ignore, text, html, latex): ignored and unordered ones go, tables prefer html, equations latex."""
    kept = F.filter(blocks, lambda b: ~F.coalesce(b["ignore"], F.lit(False)) & (b["order"] >= 0))
    said = lambda b: F.when(b["kind"] == "table", F.coalesce(F.nullif(b["html"], F.lit("")), F.nullif(b["latex"], F.lit("")), b["text"])).when(b["kind"] == "equation", F.coalesce(F.nullif(b["latex"], F.lit("")), b["text"])).otherwise(b["text"])
    rows = F.array_sort(F.transform(kept, lambda b, i: F.struct(b["order"].alias("order"), i.alias("i"), trimmed(F.replace(F.coalesce(said(b), F.lit("")), F.lit("\r\n"), F.lit("\n"))).alias("text"))))
    return F.array_join(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t != ""), "\n\n")


def table_text(html: Column) -> Column:
    """Markup inside tables becomes spaces; text outside tables stays as it is."""
    parts = F.split(html, r"(?i)(?=<table)|(?<=</table>)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("(?i)^<table"), F.regexp_replace(p, "<[^>]*>", " ")).otherwise(p)), "")
