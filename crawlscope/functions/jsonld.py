"""JSON-LD block extraction and strict JSON validation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered HTML tokenizer (Java regex).  Alternatives, in document order:
# a comment (its content is never markup), a raw-text element whose body
# runs to its end tag, or any other start tag consumed whole (so markup
# inside its quoted attribute values is never seen as a tag).  Group 1
# captures "<tag attrs>body" of raw-text elements; the others leave it empty.  Possessive quantifiers keep long bodies off the
# stack; \z accepts an unclosed element at end of input.
RAW_TEXT_ELEMENTS = "script|style|textarea|title|noscript|xmp|iframe|noembed|noframes"
TOKEN_RE = ("(?is)<!--.*?(?:-->|\\z)|(<(" + RAW_TEXT_ELEMENTS + ")(?=[\\s/>])"
            "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?)(?:</\\2[\\s/>]|\\z)"
            "|<[a-zA-Z][^\\s/>\"']*+(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_START_TAG_RE = "^<([a-zA-Z]+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_TYPE_ATTR_RE = "(?i)(?:^|[\\s/])type\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
LD_JSON_TYPE = "application/ld+json"

PARSE_ERROR_PREFIX = "JSON-LD parse error: "
# Messages for the two failure shapes we distinguish natively.
MSG_EMPTY_INPUT = "Unexpected end of JSON input"
MSG_INVALID_JSON = "Invalid JSON text"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ld_json_scripts(html) -> Column:
    """LD-1: raw inner texts of every ``<script type="application/ld+json">``
    in document order (array<string>); the array index is the block ordinal."""
    elements = F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(TOKEN_RE), 1)
    scripts = F.filter(elements, lambda e: F.lower(F.regexp_extract(e, "^<([a-zA-Z]+)", 1)) == "script")

    def attrs(e):
        return F.regexp_extract(e, _START_TAG_RE, 2)

    def type_value(e):
        v = F.regexp_extract(attrs(e), _TYPE_ATTR_RE, 1)
        return F.when(v.rlike("^\"[^\"]*\"$|^'[^']*'$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    ld = F.filter(scripts, lambda e: F.lower(type_value(e)) == LD_JSON_TYPE)
    return F.transform(ld, lambda e: F.substring(e, F.length(F.regexp_extract(e, _START_TAG_RE, 0)) + 1,
                                                 F.length(e)))


def strict_json_valid(raw) -> Column:
    """LD-2 / AU-8: true iff ``raw`` is exactly one complete JSON value.

    ``try_parse_json`` alone tolerates trailing text; wrapping the text in an
    array and in an object value only parses when it is one whole value.
    """
    r = _c(raw)
    return (F.try_parse_json(F.concat(F.lit("["), r, F.lit("]"))).isNotNull()
            & F.try_parse_json(F.concat(F.lit('{"k":'), r, F.lit("}"))).isNotNull())


def parse_error(raw) -> Column:
    """Error text for an invalid block, NULL for a valid one."""
    r = _c(raw)
    return F.when(strict_json_valid(r), F.lit(None).cast("string")).when(
        F.trim(F.coalesce(r, F.lit(""))) == "", F.lit(PARSE_ERROR_PREFIX + MSG_EMPTY_INPUT)
    ).otherwise(F.lit(PARSE_ERROR_PREFIX + MSG_INVALID_JSON))


# Stands before the digits of a number that is carried as a string (a private
# use character).
_MARK = "\ue000"
_PIECES_RE = '"(?:[^"\\\\]++|\\\\.)*+"|[^"]++'
_NUMBER_RE = "-?[0-9][0-9.eE+-]*+"


def carried(raw) -> Column:
    """A JSON text whose numbers are strings that start with a mark, so that no
    parser reformats them; a text that holds the mark already stays as it is."""
    r = _c(raw)
    pieces = F.transform(F.regexp_extract_all(r, F.lit(_PIECES_RE), 0), lambda x: F.when(x.startswith('"'), x).otherwise(
        F.regexp_replace(x, _NUMBER_RE, f'"{_MARK}$0"')))
    return F.when(F.lower(r).rlike(f"{_MARK}|\\\\ue000"), r).otherwise(F.array_join(pieces, ""))


def uncarried(text) -> Column:
    """The JSON text behind ``carried``."""
    return F.regexp_replace(_c(text), f'"{_MARK}({_NUMBER_RE})"', "$1")


def member_texts(text, kind) -> Column:
    """Texts of the members of a carried array, or of an object's ``@graph``:
    compact, keys in source order, strings without their quotes."""
    t = _c(text)
    return F.when(_c(kind) == "array", F.from_json(t, "array<string>")).otherwise(
        F.from_json(t, "struct<`@graph`:array<string>>")["@graph"])


def compact_json(raw) -> Column:
    """A valid JSON text without blanks between its tokens: keys keep their
    order, numbers their spelling."""
    r = _c(raw)
    whole = F.element_at(F.from_json(F.concat(F.lit("["), carried(r), F.lit("]")), "array<string>"), 1)
    v = F.try_parse_json(r)
    return F.when(variant_kind(v).isin("array", "object"), uncarried(whole)).otherwise(F.to_json(v))


def variant_kind(v) -> Column:
    """'array', 'object', 'string', 'null' or 'other' for a VARIANT value."""
    s = F.schema_of_variant(_c(v))
    return (F.when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
            .when(s == "STRING", "string").when(s == "VOID", "null").otherwise("other"))


def context_text(obj, text=None) -> Column:
    """LD-4: string @context as is, absent/null -> NULL, else compact JSON, as
    it stands in the object's carried ``text`` if that is given."""
    ctx = F.try_variant_get(_c(obj), '$["@context"]', "variant")
    k = variant_kind(ctx)
    whole = F.to_json(ctx)
    if text is not None:
        whole = F.when(k.isin("array", "object"), uncarried(F.from_json(_c(text), "struct<`@context`:string>")["@context"])).otherwise(whole)
    return (F.when(ctx.isNull() | (k == "null"), F.lit(None).cast("string"))
            .when(k == "string", F.try_variant_get(ctx, "$", "string"))
            .otherwise(whole))


def types_array(obj) -> Column:
    """LD-5: string @type -> [t]; array -> its string members; else []."""
    t = F.try_variant_get(_c(obj), '$["@type"]', "variant")
    k = variant_kind(t)
    members = F.try_variant_get(t, "$", "array<variant>")
    return (F.when(k == "string", F.array(F.try_variant_get(t, "$", "string")))
            .when(k == "array", F.transform(F.filter(members, lambda m: variant_kind(m) == "string"),
                                            lambda m: F.try_variant_get(m, "$", "string")))
            .otherwise(F.array().cast("array<string>")))
