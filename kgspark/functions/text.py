"""Scalar text functions as Column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower-case; runs of other than a-z, 0-9 and _ become one _; none at the ends; 'entity' if nothing is left."""
    # each step stands once in the next, as Spark would work out all of it again for each mention; never null, so no filter does either
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(s, "^_+|_+$", ""), "^$", "entity")


def label(c: Column, default: str = "Entity") -> Column:
    """A graph label: other than letters, digits and _ become _, runs of _ one; a digit in front gets a _ before it."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_]", "_"), "_+", "_")
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def relation_type(c: Column) -> Column:
    """A relation type: a label in upper case."""
    return F.upper(label(c, "RELATED_TO"))


def safe_filename(c: Column) -> Column:
    """The last part of a path, without a drive; null for nothing, '.', '..' and names with NUL."""
    s = F.trim(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), "^[A-Za-z]:", ""))
    return F.when(s.isin("", ".", "..") | c.contains("\0"), F.lit(None)).otherwise(s)


@lru_cache(1)
def _folding() -> tuple[str, str, str]:
    """Compatibility decomposition without combining marks, of what becomes a-z or 0-9: signs and what each becomes,
    then the marks, which go; and those that become several as JSON."""
    one, several, marks = {}, {}, []
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if any(x in "abcdefghijklmnopqrstuvwxyz0123456789" for x in plain):
                (one if len(plain) == 1 else several)[c] = plain
    return "".join(one) + "".join(marks), "".join(one.values()), json.dumps(several)


def normalized_key(c: Column) -> Column:
    """Lower-case, decomposed (NFKD) and without combining marks; other than a-z, 0-9 become one space."""
    signs, plain, several = _folding()
    s = F.translate(F.lower(c), signs, plain)
    known = F.from_json(F.lit(several), "map<string, string>")
    spread = F.array_join(F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    s = F.when(s.rlike(r"^[\x00-\x7F]*$"), s).otherwise(spread)
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


#: A tag up to its >, which a value in quotes may hold.
TAG = r"""<(?=[A-Za-z/!?])(?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>"""


def html_to_text(c: Column) -> Column:
    """Scripts, styles, comments and tags out, character references decoded, white space to one space.

    References to a character's number and those with a name that ends in ; are decoded once, from left to right;
    others stay as they are. A < that starts no tag stays, too.
    """
    s = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(s, TAG, " ")), r"[ \t\r\n\u00a0]+", " "))


def decoded(c: Column) -> Column:
    """A text with its character references decoded; those of control characters and of no character stay."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string, string>")
    parts = F.split(c, "&")
    ref = lambda x: F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)

    def char(r: Column) -> Column:
        digits = F.when(r.rlike("^#[xX]"), F.conv(F.substring(r, 3, 9), 16, 10)).otherwise(F.substring(r, 2, 9)).try_cast("int")
        sound = (digits >= 32) & (digits <= 0x10FFFF) & ~digits.between(0xD800, 0xDFFF) | digits.isin(9, 10, 13)
        # four bytes of UTF-32 are a character
        letter = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
        return F.when(F.startswith(r, F.lit("#")), F.when(sound, letter)).otherwise(F.try_element_at(names, r))

    def one(x: Column) -> Column:
        r = ref(x)
        return F.coalesce(F.when(r != "", F.concat(char(r), F.substring(x, F.length(r) + 2, F.length(x)))), F.concat(F.lit("&"), x))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), one)
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(rest, "")))


def is_blank(c: Column) -> Column:
    """A text that is null or white space alone."""
    return ~F.coalesce(c, F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")


def is_relation_line(c: Column) -> Column:
    """A text that is one relation, 'a -> TYPE -> b', of at most 300 characters."""
    return c.rlike(r"^[^>\n]+->\s*[A-Z_]+\s*->\s*[^\n]+$") & (F.length(c) <= 300)


def is_entity_stub(c: Column) -> Column:
    """A name rather than a sentence: under 80 characters, not ended by . ? or !"""
    t = F.trim(c)
    return (t != "") & (F.length(t) < 80) & ~t.rlike("[.?!]$")


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' word sets."""
    x, y = (F.array_distinct(F.split(F.lower(c), r"\s+")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


# Openings and closings that are not part of a result's content, and how generated queries and their raw results start.
OPENINGS = (
    "here are some facts extracted from the provided text:", "facts extracted from the provided text:", "extracted facts:", "key information:", "summary:", "important points:", "main points:",
    "key facts:", "extracted information:", "document summary:", "content summary:", "text summary:", "document facts:", "content facts:", "text facts:", "based on the provided text:",
    "from the provided text:", "the text contains:", "the document contains:", "the content includes:", "the information shows:", "the facts indicate:", "the data reveals:", "the analysis shows:",
    "the summary indicates:", "the key points are:", "the main findings are:", "the important details are:", "the relevant information is:", "the document states:", "the text states:",
    "the content states:", "the information states:", "the facts show:", "the data shows:", "the analysis reveals:", "the summary shows:", "the key points show:", "the main findings show:",
    "the important details show:", "the relevant information shows:", "the following facts were extracted:", "extracted from the document:", "the document reveals:", "the text reveals:",
    "the content reveals:", "the information indicates:", "the facts demonstrate:", "the data indicates:", "the analysis indicates:", "the summary demonstrates:", "the key points indicate:",
    "the main findings indicate:", "the important details indicate:", "the relevant information indicates:", "the document demonstrates:", "the text demonstrates:", "the content demonstrates:",
    "the information demonstrates:", "the facts suggest:", "the data suggests:", "the analysis suggests:", "the summary suggests:", "the key points suggest:", "the main findings suggest:",
    "the important details suggest:", "the relevant information suggests:",
)
CLOSINGS = (
    "end of document", "end of text", "document ends", "text ends", "this concludes the document", "this concludes the text", "this ends the document", "this ends the text",
)
STEPS = (
    "query: match ", "query: select ", "query: optional match ", "query: with ", "query: create ", "query: merge ", "query: for ", "query: g.v(",
    "context: {", "context: [{", "context: [", "[{", "[{'",
)
OPENING = "(?i)^(?:" + "|".join(OPENINGS) + ")"
CLOSING = "(?i)(?:" + "|".join(CLOSINGS) + r")\z"


def stripped(c: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")


def core_content(c: Column) -> Column:
    """A result's text without one of OPENINGS and one of CLOSINGS, whatever their case."""
    return stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(c), OPENING, "")), CLOSING, ""))


def is_query_step(c: Column) -> Column:
    """A text that is a generated query or its raw results rather than content."""
    t = F.lower(F.trim(c))
    hit = F.lit(False)
    for start in STEPS:
        hit = hit | F.startswith(t, F.lit(start))
    return hit


def node_id(c: Column, forbidden: str = "") -> Column:
    """A name as a node's id: control characters and those a store forbids go, runs of white space become one space; 'unknown' if nothing is left."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", "")
    s = F.translate(s, forbidden, "") if forbidden else s
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def metadata_key(c: Column) -> Column:
    """A key for stores that take names alone: white space and hyphens become _, other signs go, a digit in front gets a _; _unknown if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\s\-]+", "_"), "[^A-Za-z0-9_]", "")
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("_unknown")).otherwise(s)


def normal_path(c: Column) -> Column:
    """A path without . and empty parts, each .. taking the part in front of it; . if nothing is left; null and '' stay. Three slashes or more in front count as one."""
    root = F.when(c.rlike("^//[^/]|^//$"), "//").when(F.startswith(c, F.lit("/")), "/").otherwise("")
    parts = F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))

    def step(t: Column, x: Column) -> Column:
        last = F.try_element_at(t, F.lit(-1))
        up = (x == "..") & last.isNotNull() & (last != "..")
        return F.when(up, F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).when((x == "..") & last.isNull() & (root != ""), t).otherwise(F.array_append(t, x))

    s = F.concat(root, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(c == "", c).when(s == "", F.lit(".")).otherwise(s)


def timestamp(c: Column) -> Column:
    """An ISO date or time, with Z, an offset or none (the session's zone), as a timestamp; null for anything else."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(c.rlike(iso), F.translate(c, ",", ".").try_cast("timestamp"))


def uuid5(namespace: str, c: Column) -> Column:
    """The version 5 UUID of a name: of the SHA-1 of the namespace's sixteen bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def synonyms(raw: Column, original: Column) -> Column:
    """The parts of a text between ^, trimmed, each once whatever its case, without the original."""
    parts = F.filter(F.transform(F.split(raw, r"\^"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != F.lower(original)))

    def step(t: Column, x: Column) -> Column:
        return F.when(F.exists(t, lambda y: F.lower(y) == F.lower(x)), t).otherwise(F.array_append(t, x))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def article(c: Column, language: str = "en") -> Column:
    """(title, language) of an encyclopedia's article: from its web address, decoded, or a title as it stands."""
    pattern = r"https?://(?:www\.)?([a-zA-Z]{2,3})\.wikipedia\.org/wiki/(.*)"
    t = F.trim(c)
    # a + is no space in a path
    title = F.try_url_decode(F.replace(F.regexp_extract(t, pattern, 2), F.lit("+"), F.lit("%2B")))
    return F.when(t.rlike(pattern), F.struct(title.alias("title"), F.regexp_extract(t, pattern, 1).alias("language"))).otherwise(F.struct(t.alias("title"), F.lit(language).alias("language")))


# How answers without a result start, and what they hold.
NO_ANSWER_STARTS = (
    "i don't have", "i do not have", "no information", "not enough information", "cannot find", "could not find", "no results", "i don't know", "i do not know", "i couldn't find", "i could not find", "no data", "not found",
    "unable to find", "unable to answer", "the information provided does not", "the provided information does not", "the context does not", "the data does not", "based on the information provided, i cannot",
    "based on the provided information, i cannot", "i'm sorry, but i don't", "i'm sorry, but i do not", "i'm sorry, i don't", "i'm sorry, i do not", "i am sorry, but i don't", "i am sorry, but i do not",
)
NO_ANSWER_PARTS = (
    "unable to determine", "unable to specify", "cannot be determined", "does not specify who", "does not mention who", "does not contain information", "no relevant information", "not mentioned in the", "not specified in the",
)


def is_no_answer(c: Column) -> Column:
    """A text that says that there is no answer, by how it starts or what it holds, in any case; false for null."""
    t = F.lower(stripped(F.coalesce(c, F.lit(""))))
    return t.rlike("^(?:" + "|".join(NO_ANSWER_STARTS) + ")|" + "|".join(NO_ANSWER_PARTS))


def query_language(c: Column) -> Column:
    """The language of a generated query, by the first of these that it holds: sparql, gremlin, aql, cypher, else unknown."""
    q = F.upper(c)
    kind = (
        F.when(q.rlike("SELECT|CONSTRUCT|ASK|DESCRIBE"), "sparql").when(c.rlike(r"g\.[VE]\("), "gremlin")
        .when(F.contains(q, F.lit("FOR ")) & F.contains(q, F.lit(" RETURN ")), "aql").when(q.rlike("MATCH|CREATE|MERGE"), "cypher")
    )
    return F.coalesce(kind, F.lit("unknown"))
