"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s"


def simple_tokens(text: Column) -> Column:
    """Maximal runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def han_tokens(text: Column) -> Column:
    """Like simple_tokens, but every Han character is a token by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}&&[^\p{IsHan}]]+|\p{IsHan})"), 1)


def space_tokens(text: Column) -> Column:
    """White-space words in lower case, without the punctuation around them; empty ones are dropped."""
    words = F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[.,!?;:"'()\[\]{}<>]+|[.,!?;:"'()\[\]{}<>]+$""", ""))
    return F.filter(words, lambda w: w != "")


def trim(text: Column) -> Column:
    """White space of all scripts cut from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fields(text: Column) -> Column:
    """The white-space words of a text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences with their end mark, trimmed; what is left after the last mark is one as well."""
    parts = F.regexp_extract_all(text, F.lit(r"([^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$)"), 1)
    return F.filter(F.transform(parts, trim), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, then '...'."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def highlight(text: Column, query: Column) -> Column:
    """Every word of the query of two bytes or more is put between ** in the text, one word after the other."""
    words = F.filter(fields(query), lambda w: F.octet_length(w) >= 2)
    return F.aggregate(words, text, lambda t, w: F.replace(t, w, F.concat(F.lit("**"), w, F.lit("**"))))


def byte_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance over the UTF-8 bytes; -1 for more than most, which costs less to find out."""
    raw = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(raw(a), raw(b), most)


def clean_fts(query: Column) -> Column:
    """A query without the signs that a full-text parser would read as operators."""
    return trim(F.regexp_replace(F.regexp_replace(query, r"[*^(){}\[\]:;~\"]", " "), r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of each word, padded with two spaces before and one after."""
    words = F.transform(simple_tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def is_han(text: Column) -> Column:
    return text.rlike(r"^\p{IsHan}+$")


def is_punctuation(text: Column) -> Column:
    return text.rlike(r"^[\p{P}\s]+$")


def word_count(text: Column) -> Column:
    return F.size(fields(text))


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; the first one's values win."""
    return F.map_concat(first, F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)))


def extension(path: Column) -> Column:
    """The part from the last dot of the file name on, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def doc_type(path: Column) -> Column:
    """The type that the extension tells; text if it is unknown."""
    e = extension(path)
    return (
        F.when(e == ".pdf", "pdf").when(e.isin(".docx", ".doc"), "docx").when(e.isin(".md", ".markdown"), "md")
        .when(e.isin(".html", ".htm"), "html").when(e == ".csv", "csv").when(e == ".json", "json").otherwise("txt")
    )


def path_title(path: Column, empty: str = "") -> Column:
    """The file name without its extension."""
    title = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.when(title == "", F.lit(empty)).otherwise(title)


def strip_tags(html: Column) -> Column:
    """Text outside of <...>, line by line, trimmed and without empty lines. Script bodies stay; an open tag takes the rest."""
    bare = F.regexp_replace(html, r"<[^>]*>?|>", "")
    lines = F.filter(F.transform(F.split(bare, "\n"), trim), lambda x: x != "")
    return F.array_join(lines, "\n")


def html_title(html: Column) -> Column:
    """What stands in <title> or <TITLE>, trimmed; '' if there is none."""
    return trim(F.regexp_extract(html, r"(?s)<(?:title|TITLE)>(.*?)</(?:title|TITLE)>", 1))


def without_blocks(html: Column) -> Column:
    """HTML without script, style and noscript elements and their contents."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}>", "")
    return html


def html_text(html: Column) -> Column:
    """Text of a piece of HTML in one line: tags become a space each, runs of blanks one."""
    return trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>?|>", " "), r"[ \t]+", " "))


def list_items(html: Column) -> Column:
    """The texts of all <li> elements."""
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<li[^>]*>([\s\S]*?)</li>"), 1), html_text)
    return F.filter(items, lambda x: x != "")


# The entities that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"))


def decode_entities(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def front_matter(text: Column) -> Column:
    """Key and value of the lines between the first two '---' lines; comments are skipped, the first colon splits."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    pair = lambda x: F.struct(trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']|[\"']$", "").alias("v"))
    pairs = F.filter(F.transform(lines, pair), lambda p: p["k"] != "")
    # of a repeated key the last line counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def markdown_title(text: Column) -> Column:
    """The first '# ' heading, '' if there is none."""
    return trim(F.regexp_extract(text, r"(?m)^#[ \t]+([^\n]+)$", 1))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), trim), lambda p: p != "")


def format_time(time: Column) -> Column:
    """A timestamp as text in UTC with microseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_time(text: Column) -> Column:
    """The timestamp of a text in one of the common forms; null for anything else."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
