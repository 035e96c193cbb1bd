"""Keys, identifiers and byte-exact text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
TOKEN = r"[\p{L}\p{N}]+"


def octets(s: Column) -> Column:
    return F.octet_length(s)


def length_prefixed(s: Column) -> Column:
    """Byte length, a colon, and the text: pieces so written can be joined without ambiguity."""
    return F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)


def _kept(s: Column, separator: str) -> Column:
    low = F.lower(F.trim(s))
    runs = F.regexp_replace(low, r"[^\p{L}\p{Nd}\p{Mn}]+", separator)
    return F.btrim(runs, F.lit(separator))


def slug(s: Column) -> Column:
    return _kept(s, "-")


def relation_type(s: Column) -> Column:
    return _kept(s, "_")


def canonical_key(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(F.trim(kind)), F.lit(":"), slug(name))


def unresolved_key(kind: Column, name: Column, conversation: Column) -> Column:
    return F.concat(F.lit("unresolved-"), canonical_key(kind, name), F.lit("-"), conversation)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a UTF-8 name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def entity_id(workspace: Column, key: Column) -> Column:
    return uuid5(F.concat(length_prefixed(workspace), length_prefixed(key)))


def unit_id(anchor: Column, model: Column, strategy: Column, version: Column) -> Column:
    parts = (anchor.cast("string"), model, strategy, version.cast("string"))
    return uuid5(F.concat(*map(length_prefixed, parts)))


def dedup_key(source: Column, kind: Column, target: Column, literal: Column, valid_from: Column) -> Column:
    """Identity of a relation; a missing start differs from every date."""
    goal = F.when(target.isNotNull(), F.concat(F.lit("ent:"), target)).otherwise(F.concat(F.lit("lit:"), F.lower(F.trim(F.coalesce(literal, F.lit(""))))))
    since = F.coalesce(F.concat(F.lit("at:"), F.date_format(valid_from, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(""))
    return F.concat(*map(length_prefixed, (source, relation_type(kind), goal, since)))


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(0))


def join_french(items: Column) -> Column:
    n = F.size(items)
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(items, 1)).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" et "), F.element_at(items, -1)))


def truncate_bytes(s: Column, limit: Column) -> Column:
    """The longest prefix of whole characters within a number of UTF-8 bytes."""
    raw, at = F.encode(s, "UTF-8"), limit.cast("int")
    follows = lambda p: F.conv(F.hex(F.substring(raw, p, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80
    back = F.when(~follows(at + 1), at).when(~follows(at), at - 1).when(~follows(at - 1), at - 2).otherwise(at - 3)
    return F.when(at <= 0, F.lit("")).when(F.octet_length(s) <= at, s).otherwise(F.decode(F.substring(raw, F.lit(1), back), "UTF-8"))


def strip_fences(s: Column) -> Column:
    """Text without a surrounding Markdown code fence."""
    bare = F.trim(s)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def tokens_estimate(s: Column) -> Column:
    return F.floor(F.octet_length(s) / 4)


def cursor(at: Column, message: Column) -> Column:
    return F.base64(F.encode(F.concat_ws("|", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), message.cast("string")), "UTF-8"))


def fact_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, obj)


def token_hash(secret: Column) -> Column:
    return F.sha2(secret, 256)


def parse_time(s: Column) -> Column:
    """RFC 3339 time, null if it is not one."""
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(s))


#: Pronouns and determiners, which are no alias of anything.
NO_ALIAS = (
    "je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "me", "te", "se", "moi", "toi", "soi", "lui", "leur", "leurs", "en", "y",
    "ce", "cet", "cette", "ces", "ca", "cela", "ceci", "celui", "celle", "ceux", "celles", "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses",
    "notre", "nos", "votre", "vos", "le", "la", "les", "un", "une", "des", "du", "de", "au", "aux", "qui", "que", "quoi", "dont", "ou",
    "the", "it", "they", "them", "its",
)
#: Fixed value: marks around an alias that do not count when it is compared.
AROUND = "'\u2019.,;:!?"


def clean_aliases(aliases: Column) -> Column:
    """Trimmed aliases of two characters or more that are no pronoun or determiner, the first of those equal but for case and marks around."""
    bare = lambda a: F.lower(F.btrim(a, F.lit(AROUND)))
    trimmed = F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: (F.length(bare(a)) >= 2) & ~bare(a).isin(*NO_ALIAS))
    return F.filter(trimmed, lambda a, i: F.array_position(F.transform(trimmed, bare), bare(a)) == i + 1)


def query_text(requester: Column, subjects: Column, recent: Column, question: Column, last: int = 4) -> Column:
    """The text of a query to embed: who asks, what is known to be meant, the last messages, the question.

    recent: array of struct (author_key, content), oldest first. The words are fixed.
    """
    asks = F.when(F.coalesce(requester, F.lit("")) != "", F.concat(F.lit("Demandeur : "), requester, F.lit("\n"))).otherwise("")
    meant = F.array_join(F.transform(F.coalesce(subjects, F.array().cast("array<string>")), lambda s: F.concat(F.lit("Sujet mentionné : "), s, F.lit("\n"))), "")
    kept = F.slice(recent, F.greatest(F.size(recent) - last, F.lit(0)) + 1, F.lit(last))
    lines = F.array_join(F.transform(kept, lambda m: F.concat(m["author_key"], F.lit(" : "), m["content"], F.lit("\n"))), "")
    context = F.when(F.size(recent) > 0, F.concat(F.lit("\nContexte récent :\n"), lines)).otherwise("")
    return F.concat(asks, meant, context, F.lit("\nQuestion actuelle :\n"), F.coalesce(question, F.lit("")))


def parse_cursor(s: Column) -> Column:
    """The struct (at, id) of a cursor; null if it is none."""
    raw = F.unbase64(F.when(s.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(s) % 4 == 0), s)).cast("string")
    whole = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\|-?\d{1,18}$"), raw)
    at = F.try_to_timestamp(F.split_part(whole, F.lit("|"), F.lit(1))).cast("timestamp_ntz")
    return F.when(at.isNotNull(), F.struct(at.alias("at"), F.split_part(whole, F.lit("|"), F.lit(2)).cast("bigint").alias("id")))
